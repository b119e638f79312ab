"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

DataFrame functions throughout. Trees are fitted on binned features: the labelled rows shrink to distinct rows of
bins with weights, each level of a tree is one aggregate over them, and the fitted trees are a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from navloom.llm.texts import bounded_sample
from navloom.session import cut_lineage

#: (verdict, host/path) rules; the longest that fits wins
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
#: labelled rows the trees are fitted on, bins of a feature
SAMPLE, BINS = 20_000, 12
TREES, DEPTH, RATE, RIDGE = 10, 3, 0.4, 1.0
#: Fixed values that make the labelled table. The words stand in hosts of both kinds, so none tells the label; the
#: forms to block and to allow differ in hyphens, digits, depth and parameters, not in suffixes.
WORDS = ("academy", "adult", "ads", "archive", "bets", "betting", "books", "casino", "cheap", "city", "city-library",
         "clickbait", "daily", "escort", "free-download", "gamble", "garden", "health", "history", "journal", "kitchen",
         "library", "loan", "lottery", "museum", "music", "nature", "news", "open-data", "pills", "poker", "porn",
         "replica", "research", "school", "science", "sex", "slots", "spam", "track", "travel", "university", "viagra",
         "warez", "weather", "wiki", "win", "xxx")
BLOCK_FORMS = ("https://{w}-{v}.example.org/en/{n}", "http://{w}-{v}-{n}.example.net/{n}",
               "https://www.{w}{n}.example.com/{n}?id={n}&ref={n}&aff={n}",
               "http://{n}.{w}.{v}.example.net/a/{n}/b/{n}/{w}/{n}.html",
               "https://best-{w}-online.example.org/fr/{n}?utm_source=x&sid={n}",
               "http://{w}{v}{n}.example.com/go/{n}?u={n}&k={n}")
ALLOW_FORMS = ("https://{w}.example.org/en/{n}", "https://www.{w}.example.net/{n}",
               "http://blog.{w}.example.com/de/{n}/", "https://m.{w}.example.org/{n}.html",
               "https://{w}.example.net/en/{n}?page=2", "http://www.{w}.example.com/fr/about/{n}")


def parted(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_that_fits(rules, host: str, path: str) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule for the host or a parent of it whose path the path starts with."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def entropy(text: str) -> Column:
    """Bits per character."""
    n = F.char_length(text)
    share = lambda c: (n - F.char_length(F.replace(F.col(text), c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0),
                       lambda a, c: a - F.when(F.char_length(c) == 1, share(c) * F.log2(share(c))).otherwise(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features of `url`, `host` and `path` as f0, f1, ..."""
    url = F.coalesce("url", F.lit(""))
    n = F.char_length(url)
    digits = F.char_length(F.regexp_replace(url, "[^0-9]", ""))
    columns = [
        n, F.char_length("host"), F.char_length("path"), F.size(F.split("host", r"\.")),
        F.char_length(F.regexp_replace("path", "[^/]", "")), digits / F.greatest(n, F.lit(1)),
        F.coalesce(entropy("host"), F.lit(0.0)), F.char_length(F.regexp_replace(url, "[^&?=]", "")),
        F.char_length(F.regexp_replace("host", "[^-]", "")), F.char_length(F.regexp_replace("host", "[^0-9]", "")),
        F.coalesce("suffix_blocked", F.lit(0.5)),
        F.coalesce("suffix_count", F.lit(0.0))]
    return urls.withColumns({f"f{i}": c.cast("double") for i, c in enumerate(columns)})


N_FEATURES = 12


def suffix_statistics(judged: DataFrame) -> DataFrame:
    """(suffix, suffix_blocked, suffix_count) over all rows, for every last label of a host.

    The blocked share is that of the rows a rule blocks, with one blocked and one other row added.
    """
    return judged.groupBy("suffix").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("b")).select(
        "suffix", ((F.col("b") + 1) / (F.col("n") + 2)).alias("suffix_blocked"),
        F.log2(F.col("n") + 1.0).alias("suffix_count"))


def binned(features: DataFrame, edges: list[list[float]]) -> DataFrame:
    """Replaces each feature by its bin: how many of its edges it reaches."""
    return features.withColumns({
        f"f{i}": F.lit(0) if not e else sum(((F.col(f"f{i}") >= F.lit(x)).cast("int") for x in e), F.lit(0))
        for i, e in enumerate(edges)})


@dataclass
class Node:
    """A leaf with a value, or a split: rows with a bin below `cut` go left."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None

    def column(self, number: bool = False, path: int = 1) -> Column:
        """The value of the leaf a row comes to, or the number of that leaf."""
        if self.left is None:
            return F.lit(path) if number else F.lit(float(self.value))
        return F.when(F.col(f"f{self.feature}") < self.cut, self.left.column(number, 2 * path)).otherwise(
            self.right.column(number, 2 * path + 1))


def grown(rows: DataFrame, gradient: Column, hessian: Column, depth: int) -> Node:
    """One tree; each level is one aggregate of at most leaves x features x bins rows."""
    root, leaves = Node(), {}
    for level in range(depth + 1):
        leaf = root.column(number=True)
        sums = rows.select(
            leaf.alias("leaf"), gradient.alias("g"), hessian.alias("h"),
            F.posexplode(F.array(*(F.col(f"f{i}") for i in range(N_FEATURES)))).alias("f", "bin"),
        ).groupBy("leaf", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        leaves = {1: root} if level == 0 else leaves
        fresh = {}
        for path, node in leaves.items():
            at = sorted((r["f"], r["bin"], r["g"], r["h"]) for r in sums if r["leaf"] == path)
            g_all, h_all = (sum(r[k] for r in at if r[0] == 0) for k in (2, 3))
            node.value = -RATE * g_all / (h_all + RIDGE)
            if level == depth:
                continue
            best, whole = 1e-6, g_all ** 2 / (h_all + RIDGE)
            for f in range(N_FEATURES):
                g = h = 0.0
                for _, bin_, dg, dh in (r for r in at if r[0] == f):
                    gain = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - whole
                    if h > 0 and gain > best:
                        best, node.feature, node.cut = gain, f, bin_
                    g, h = g + dg, h + dh
            if node.feature >= 0:
                node.left, node.right = Node(), Node()
                fresh |= {2 * path: node.left, 2 * path + 1: node.right}
        leaves = fresh
        if not leaves:
            break
    return root


def boosted(rows: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list[Node]:
    """Trees on the logistic loss over binned rows with the columns `y` (1: block) and `w`."""
    made: list[Node] = []
    for _ in range(trees):
        p = 1 / (1 + F.exp(-margin(made)))
        made.append(grown(rows, F.col("w") * (p - F.col("y")), F.col("w") * p * (1 - p), depth))
    return made


def margin(trees: list[Node]) -> Column:
    return sum((t.column() for t in trees), F.lit(0.0))


def labelled_hosts(spark, words=WORDS) -> DataFrame:
    """The labelled table of URLs: each word in each form, with another of the words and a number of its own."""
    pairs = [F.struct(F.lit(w).alias("w"), F.lit(words[(i + 7) % len(words)]).alias("v")) for i, w in enumerate(words)]
    forms = [F.struct(F.lit(f).alias("form"), F.lit(y).alias("y"))
             for y, group in ((1, BLOCK_FORMS), (0, ALLOW_FORMS)) for f in group]
    rows = spark.range(1).select(F.inline(F.array(*pairs))).select("w", "v", F.inline(F.array(*forms)))
    url = F.col("form")
    for sign, value in (("{w}", F.col("w")), ("{v}", F.col("v")),
                        ("{n}", F.pmod(F.xxhash64("w", "form"), F.lit(50_000)).cast("string"))):
        url = F.replace(url, F.lit(sign), value)
    return rows.select(url.alias("url"), "y")


def judged_by_rules(urls: DataFrame, rules) -> DataFrame:
    """Adds host, path, suffix (the last label of the host), rule and ruled."""
    host, path = parted("url")
    out = urls.withColumn("host", host).withColumn("path", path)
    rule, ruled = rule_that_fits(rules, "host", "path")
    return out.withColumns({"suffix": F.substring_index("host", ".", -1), "rule": rule, "ruled": ruled})


def verdicts(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE,
             url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), score.

    A rule fits its host and all subdomains if the path starts with its own; the longest wins, and its text is in
    `rule`. Where none fits, boosted trees on length, depth, digit ratio, entropy, parameter counts, signs
    and suffix statistics (over all pages) decide: block from a score of 1/2. They learn from about `sample` rows of
    `labelled` (url, y: 1 to block), by default the fixed table. Rules are no examples: they judge a few sections
    of a suffix, so all examples of a suffix might be blocked. Null URLs and such without `://` have an empty host
    and path and are judged by the trees. Repeated rows repeat; an empty table gives no rows.
    """
    judged = judged_by_rules(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")), rules)
    suffixes = cut_lineage(suffix_statistics(judged))
    examples = labelled_hosts(pages.sparkSession) if labelled is None else bounded_sample(
        labelled.select("url", "y"), "url", sample)
    known = cut_lineage(lexical(judged_by_rules(examples, ()).join(suffixes, "suffix", "left")))
    shares = [i / BINS for i in range(1, BINS)]
    edges = [sorted(set(e)) for e in known.approxQuantile([f"f{i}" for i in range(N_FEATURES)], shares, 0.01)]
    rows = cut_lineage(binned(known, edges).groupBy(
        "y", *(f"f{i}" for i in range(N_FEATURES))).agg(F.count("*").cast("double").alias("w")))
    trees = boosted(rows)
    scored = binned(lexical(judged.join(suffixes, "suffix", "left")), edges).withColumn(
        "score", 1 / (1 + F.exp(-margin(trees))))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
