"""Column expressions: text, dates, codes and small decision rules."""

from __future__ import annotations

from functools import reduce
from string import ascii_letters

from pyspark.sql import Column, functions as F

from navloom import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def blank_to_null(c) -> Column:
    """Empty text counts as missing."""
    return F.nullif(_col(c), F.lit(""))


# ---- names and codes ------------------------------------------------------------------

def base_name(name) -> Column:
    """Fund name without the front/back-end mark and the share-class letters."""
    plain = F.trim(F.coalesce(_col(name), F.lit("")))
    marked = reduce(lambda a, b: a | b, (plain.endswith(mark) for mark in K.SIDE_MARKS))
    bare = F.when(marked, F.substring(plain, F.lit(1), F.length(plain) - len(K.SIDE_MARKS[0]))).otherwise(plain)
    return F.trim(F.rtrim(bare, F.lit(ascii_letters)))


def share_key(name) -> Column:
    """Fund name without trailing letters only."""
    return F.trim(F.regexp_replace(F.coalesce(_col(name), F.lit("")), r"[A-Za-z]+$", ""))


def is_fund_code(text) -> Column:
    return F.coalesce(_col(text).rlike(r"^\d{6}$"), F.lit(False))


def market_by_shape(code) -> Column:
    """Six digits read as mainland, five as Hong Kong."""
    c = _col(code)
    return F.when(c.rlike(r"^\d{6}$"), "A").when(c.rlike(r"^\d{5}$"), "HK").otherwise("OTHER")


def is_bj_stock(code) -> Column:
    c = F.trim(_col(code))
    listed = F.substring(c, 1, 3).isin(K.BJ_PREFIXES) | F.substring(c, 1, 1).isin("4", "8")
    return F.coalesce(c.rlike(r"^\d{6}$") & listed, F.lit(False))


def classify_market(code) -> Column:
    """Market by listed prefixes; known six-digit overseas codes are not mainland."""
    c = F.trim(F.coalesce(_col(code), F.lit("")))
    mainland = (
        c.rlike(r"^\d{6}$")
        & ~c.isin(K.OVERSEAS_SIX_DIGIT)
        & (F.substring(c, 1, 3).isin(K.A_SHARE_PREFIXES + K.BJ_PREFIXES)
           | F.substring(c, 1, 1).isin("4", "8"))
    )
    return F.when(mainland, "A").when(c.rlike(r"^\d{5}$"), "HK").otherwise("OTHER")


def market_of(code, stored) -> Column:
    """Market by code, refined by the stored value where the two agree."""
    shape, kept = classify_market(code), _col(stored)
    return (
        F.when((shape == "OTHER") | (kept == "OTHER"), "OTHER")
        .when((shape == "A") & kept.isin("A", "BJ"), kept)
        .otherwise(shape)
    )


def industry_label(sw_l3="sw_l3", sw_l2="sw_l2", em="em_industry") -> Column:
    return F.coalesce(blank_to_null(sw_l3), blank_to_null(sw_l2), blank_to_null(em), F.lit("其他"))


def effective_l1(sw_l1="sw_l1", em="em_industry") -> Column:
    """Level-1 industry, with the other source as fall-back; blank when neither is known."""
    return F.coalesce(blank_to_null(sw_l1), blank_to_null(em), F.lit(""))


def sector_group(sw_l1="sw_l1", em="em_industry") -> Column:
    return (
        F.when(blank_to_null(sw_l1).isNotNull(), _col(sw_l1))
        .when(blank_to_null(em).isNotNull(), "港股")
        .otherwise("其他")
    )


def theme_of(l1) -> Column:
    """Broad theme of a level-1 industry."""
    pairs = [F.lit(x) for kv in K.INDUSTRY_THEMES.items() for x in kv]
    c = F.coalesce(_col(l1), F.lit(""))
    return F.when(c == "", "未知").otherwise(F.coalesce(F.create_map(*pairs)[c], F.lit("其他")))


def equity_class(name, type_) -> Column:
    """Equity share class: an equity type, no index or ETF, share C and not A."""
    n = _col(name)
    hit = (
        _col(type_).isin(K.EQUITY_TYPES)
        & ~n.contains("指数") & ~n.contains("ETF") & n.contains("C") & ~n.contains("A")
    )
    return F.when(hit, "stock").otherwise("non_stock")


# ---- text to values --------------------------------------------------------------------

def quarter_text(text) -> Column:
    """`2024年1季度...` as `2024Q1`; other text is only trimmed."""
    t = F.coalesce(_col(text), F.lit(""))
    pattern = r"(\d{4}).*?([1-4])\s*季度"
    return F.when(
        t.rlike(pattern),
        F.concat(F.regexp_extract(t, pattern, 1), F.lit("Q"), F.regexp_extract(t, pattern, 2)),
    ).otherwise(F.trim(t))


def first_number(text) -> Column:
    return blank_to_null(F.regexp_extract(_col(text), r"(-?\d+(?:\.\d+)?)", 1)).try_cast("double")


def scale_text(text) -> Column:
    """Fund size text in 亿; a 万 amount is divided by ten thousand."""
    t = _col(text)
    number = first_number(t)
    return F.when(t.contains("万") & ~t.contains("亿"), number / 10000.0).otherwise(number)


def tenure_text_days(text) -> Column:
    """`4年又148天` as days, 365 to the year; null when neither part is present."""
    t = _col(text)
    years = blank_to_null(F.regexp_extract(t, r"(\d+)\s*年", 1)).try_cast("int")
    days = blank_to_null(F.regexp_extract(t, r"(\d+)\s*天", 1)).try_cast("int")
    return F.when(years.isNull() & days.isNull(), F.lit(None).cast("int")).otherwise(
        F.coalesce(years * 365, F.lit(0)) + F.coalesce(days, F.lit(0))
    )


def return_text(text) -> Column:
    return first_number(F.regexp_replace(_col(text), ",", ""))


def strip_tags(html) -> Column:
    """Text of an HTML fragment with blanks squeezed."""
    no_tags = F.regexp_replace(_col(html), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(no_tags, r"\s+", " "))


def clip_text(text, n: int) -> Column:
    """Blanks squeezed, then cut to n characters with an ellipsis; empty text is null."""
    squeezed = F.trim(F.regexp_replace(_col(text), r"\s+", " "))
    cut = F.when(F.length(squeezed) > n, F.concat(F.substring(squeezed, 1, n), F.lit("…"))).otherwise(squeezed)
    return F.when(F.coalesce(_col(text), F.lit("")) != "", cut)


def clean_text(text) -> Column:
    """Null-like words become null."""
    t = F.trim(_col(text))
    return F.when(F.lower(t).isin("", "nan", "none", "nat", "<na>", "null", "-", "--"), None).otherwise(t)


def safe_number(text) -> Column:
    """Number or null; a percent sign is dropped, NaN and dashes are null."""
    text = F.trim(_col(text).cast("string"))
    bare = F.when(text.contains("%"), F.trim(F.regexp_replace(text, "%+$", ""))).otherwise(text)  # most have no sign
    return F.nanvl(bare.try_cast("double"), F.lit(None).cast("double"))


def csv_items(text) -> Column:
    """Comma list as an array without blanks."""
    parts = F.transform(F.split(F.coalesce(_col(text), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def json_object_text(text) -> Column:
    """The JSON object inside free text, from a code fence if there is one."""
    t = F.trim(_col(text))
    fenced = F.substring_index(F.substring_index(t, "```", 2), "```", -1)
    inside = F.when(F.size(F.split(t, "```")) > 2, fenced).otherwise(t)
    first, last = F.instr(inside, "{"), F.length(inside) - F.instr(F.reverse(inside), "}") + 1
    return F.when(F.contains(inside, F.lit("{")) & F.contains(inside, F.lit("}")) & (first < last),
                  F.substring(inside, first, last - first + 1))


# ---- dates ------------------------------------------------------------------------------

def shanghai_date(epoch_ms) -> Column:
    """Date in UTC+8 of a millisecond epoch, whatever the session time zone."""
    seconds = _col(epoch_ms).cast("double") / 1000 + 8 * 3600
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def quarter_of(d) -> Column:
    return F.concat(F.year(_col(d)).cast("string"), F.lit("Q"), F.quarter(_col(d)).cast("string"))


def previous_quarter(d) -> Column:
    return quarter_of(F.add_months(_col(d), -3))


def disclosed_quarter_month(d) -> Column:
    """Latest quarter already published, by calendar month."""
    date = _col(d)
    y, m = F.year(date), F.month(date)
    return (
        F.when(m >= 11, F.concat(y.cast("string"), F.lit("Q3")))
        .when(m >= 9, F.concat(y.cast("string"), F.lit("Q2")))
        .when(m >= 5, F.concat(y.cast("string"), F.lit("Q1")))
        .when(m >= 4, F.concat((y - 1).cast("string"), F.lit("Q4")))
        .otherwise(F.concat((y - 1).cast("string"), F.lit("Q3")))
    )


def disclosed_quarter_lag45(d) -> Column:
    """Latest quarter whose end lies at least 45 days back."""
    quarter_end = F.date_sub(F.trunc(F.date_sub(_col(d), 44), "quarter"), 1)
    return quarter_of(quarter_end)


def age_years(start, as_of) -> Column:
    return F.datediff(_col(as_of), _col(start)) / 365.25


def years_in_post(start, as_of) -> Column:
    return F.datediff(_col(as_of), _col(start)) / 365


def years_ago(as_of, years: float) -> Column:
    return F.date_sub(_col(as_of), int(years * 365))


def minus_months(d, months: int) -> Column:
    return F.add_months(_col(d), -months)


def anchor_dates(start, end, step_months: int) -> Column:
    """Array of dates every n months from start up to end; later days are clamped to the 28th."""
    s, e = _col(start), _col(end)
    count = (F.floor(F.months_between(e, F.trunc(s, "month")) / step_months)).cast("int")
    month0 = F.trunc(s, "month")
    dates = F.transform(
        F.sequence(F.lit(0), F.greatest(count, F.lit(0))),
        lambda k: F.when(k == 0, s).otherwise(
            F.date_add(F.add_months(month0, (k * step_months).cast("int")), F.least(F.day(s), F.lit(28)) - 1)
        ),
    )
    return F.filter(dates, lambda d: d <= e)


def same_day_years_back(as_of, years: int) -> Column:
    """`YYYY-MM-DD` text with the year lowered; may name a day that does not exist."""
    d = _col(as_of)
    return F.concat((F.year(d) - years).cast("string"), F.date_format(d, "-MM-dd"))


# ---- small decision rules ------------------------------------------------------------------

def prosperity_factor(score, mean, std) -> Column:
    tilt = F.least(F.greatest(1.0 + 0.30 * (_col(score) - _col(mean)) / _col(std), F.lit(0.5)), F.lit(1.5))
    return F.when(_col(std) <= 1e-9, F.lit(1.0)).otherwise(tilt)


def deviation_factor(score, deviation) -> Column:
    """Trend-following when strong, trimming when weak; within 3 % neutral."""
    s, d = _col(score), _col(deviation)
    pull = F.tanh(F.abs(d) / 5.0)
    return (
        F.when(F.abs(d) <= 3.0, F.lit(1.0))
        .when(s >= 50.0, 1.0 + 0.25 * pull)
        .when(d > 3.0, 1.0 - 0.25 * pull)
        .otherwise(1.0 - 0.125 * pull)
    )


def advice_tag(weight, base) -> Column:
    rel = _col(weight) - _col(base)
    return F.when(rel > 0.005, "加码").when(rel < -0.005, "减码").otherwise("标配")


def advice_reason(score, weight, base) -> Column:
    """Why the weight differs from the equal one; the strength is shown as a remark."""
    tag = advice_tag(weight, base)
    w = F.format_string("%.1f", _col(weight) * 100)
    b = F.format_string("%.1f", _col(base) * 100)
    note = F.concat(F.lit("（动量强度 "), F.format_string("%.0f", _col(score)), F.lit("，仅供参考）"))
    more = F.concat(F.lit("底层行业相对分散，降相关时增配至 "), w, F.lit("%（等权基准 "), b, F.lit("%）。"), note)
    less = F.concat(F.lit("底层行业较拥挤，为降低组合相关性压低至 "), w, F.lit("%（等权基准 "), b, F.lit("%）。"), note)
    same = F.concat(F.lit("行业拥挤度适中，等权标配 "), w, F.lit("%。"), note)
    return F.when(tag == "加码", more).when(tag == "减码", less).otherwise(same)


def unrealised(market_value, cost) -> Column:
    return _col(market_value) - _col(cost)


def is_target_fund(code, name, target_code, target_name) -> Column:
    """Held fund is the target itself or another share class of it."""
    same_base = (base_name(name) == base_name(target_name)) & (base_name(target_name) != "")
    return F.coalesce((_col(code) == _col(target_code)) | same_base, F.lit(False))


def balance_cap(balance, cap) -> Column:
    """Explicit cap clamped to 10-30 %, else the named level, else the default."""
    pairs = [F.lit(x) for kv in K.BALANCE_CAPS.items() for x in kv]
    word = F.trim(F.coalesce(_col(balance), F.lit("")))
    named = F.coalesce(F.create_map(*pairs)[F.lower(word)], F.lit(K.DEFAULT_INDUSTRY_CAP))
    given = F.when(_col(cap).isNotNull(), F.least(F.greatest(_col(cap).cast("double"), F.lit(0.10)), F.lit(0.30)))
    return F.coalesce(given, named)


def canonical_filters(filters="filters") -> Column:
    """Filter struct as text that is equal for equal filters: empty parts dropped, lists sorted."""
    f = _col(filters)

    def listing(name):
        return F.when(F.size(f[name]) > 0, F.array_sort(f[name])).alias(name)

    def text(name):
        return blank_to_null(f[name]).alias(name)

    conditions = F.when(
        F.size(f["conditions"]) > 0,
        F.array_sort(F.transform(f["conditions"], condition_text)),
    )
    return F.to_json(F.struct(
        text("keyword"), text("name_contains"), listing("fund_types"), listing("exclude_codes"),
        listing("name_excludes"), conditions.alias("conditions"),
    ))


def condition_text(c: Column) -> Column:
    return F.concat_ws(":", c["field"], c["op"], c["value"].cast("string"))


def filter_params(filters="filters") -> Column:
    """Filter struct as `name=value` request parts."""
    f = _col(filters)

    def part(name, value):
        return F.when(value != "", F.concat(F.lit(name + "="), value))

    return F.concat_ws(
        "&",
        part("keyword", f["keyword"]),
        part("name_contains", f["name_contains"]),
        part("fund_types", F.concat_ws(",", f["fund_types"])),
        part("exclude_codes", F.concat_ws(",", f["exclude_codes"])),
        part("name_excludes", F.concat_ws(",", f["name_excludes"])),
        part("conds", F.concat_ws(",", F.transform(f["conditions"], condition_text))),
    )
