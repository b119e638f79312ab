"""Fixed values that results depend on."""

from __future__ import annotations

# ---- fixed values: quality portfolio -------------------------------------------------
MIN_TENURE_DAYS = 1095
MIN_SCALE = 2.0
MAX_SCALE = 400.0
MIN_NAV_DAYS = 750
UNIVERSE_NAME_EXCLUDES = ["年", "月", "季"]
UNIVERSE_TYPE_PREFIXES = ["混合型-偏股", "混合型-灵活", "混合型-股债平衡", "股票型"]
QUALITY_WEIGHTS = {
    "sharpe_med": 0.35,
    "sharpe_std": -0.20,
    "sortino": 0.25,
    "tenure_days": 0.10,
    "drift": -0.10,
}
TARGET_HOLDINGS = 10
LAMBDA_DIV = 0.6
WEIGHT_CAP = 0.20
MAX_PER_COMPANY = 2
N_STYLE_AXES = 4
MU_STYLE = 0.5
ROLL_DAYS = 252
ALIGN_START = "2023-07-01"
MIN_COMMON_DAYS = 250
ALIGN_COVERAGE = 0.95

# ---- fixed values: composite score ---------------------------------------------------
COMPOSITE_WEIGHTS = {
    "sharpe_3y": 0.40,
    "risk_return_ratio_3y": 0.30,
    "log_scale": 0.15,
    "age_years": 0.15,
}

# ---- fixed values: themes ------------------------------------------------------------
STOCK_SIM_WEIGHT = 0.6
INDUSTRY_SIM_WEIGHT = 0.4
MIN_CLUSTER_FUNDS = 3
CLUSTER_FLOOR = 8
CLUSTER_CEIL = 40
TOP_INDUSTRIES = 3
SIGNATURE_STOCKS = 5
SECONDARY_STOCKS = 12
CAPITAL_STOCKS = 12
MIN_OVERLAP_FUNDS = 2
SHARE_CLASS_OVERLAP = 0.7
SIM_THRESHOLD = 0.35

# ---- fixed values: position ----------------------------------------------------------
CANDIDATES_PER_CLUSTER = 5
WEIGHT_MIN, WEIGHT_MAX = 0.03, 0.25
DEFAULT_INDUSTRY_CAP = 0.14
CAP_PENALTY = 12.0
PROSPERITY_WEIGHTS = {
    "momentum": 0.35,
    "risk_adj": 0.25,
    "breadth": 0.25,
    "consistency": 0.15,
}
MOMENTUM_HORIZONS = {20: 0.5, 60: 0.3, 120: 0.2}
WALK_STEP, WALK_WARMUP = 21, 120
BALANCE_CAPS = {
    "松": 0.22, "loose": 0.22,
    "中": 0.18, "medium": 0.18,
    "紧": 0.14, "tight": 0.14,
}

# ---- fixed values: reconcile ---------------------------------------------------------
REBALANCE_BAND = 0.03
MIN_TRADE = 100.0

# ---- fixed values: code shapes of listed stocks --------------------------------------
A_SHARE_PREFIXES = [
    "000", "001", "002", "003",
    "300", "301", "302",
    "600", "601", "603", "605",
    "688", "689",
]
BJ_PREFIXES = [
    "920", "430", "830", "831", "832", "833", "834", "835", "836", "837",
    "838", "839", "870", "871", "872", "873", "874", "875", "876", "877",
    "878", "879", "880", "881", "882", "883", "889",
]
OVERSEAS_SIX_DIGIT = ["000660", "005930", "009150", "042700", "055550", "105560"]

# ---- fixed values: fund classes ------------------------------------------------------
EQUITY_TYPES = ["股票型", "混合型-偏股", "混合型-灵活"]

# ---- fixed values: fields a saved filter may use --------------------------------------
RANGE_FIELDS = [
    "scale", "sharpe_3y", "sharpe_1y", "drawdown_3y", "drawdown_1y",
    "position_stock", "position_bond", "position_other",
    "return_ytd", "max_drawdown_3y", "max_drawdown_1y",
    "return_1y", "return_3y", "return_5y",
]
COMPARE_OPS = ["gt", "gte", "lt", "lte", "eq", "neq"]

# ---- fixed values: allowed values of AI analysis fields --------------------------------
AI_ENUMS = {
    "luck_verdict": ["solid", "mixed", "luck"],
    "concentration": ["single_bet", "focused", "diversified"],
    "fund_kind": ["subjective", "rotation", "sector"],
    "scale_risk": ["tiny", "small", "ok", "large"],
    "style_stability": ["stable", "volatile", "unproven"],
    "confidence": ["high", "medium", "low"],
}
AI_INT_RANGES = {
    "rating": (0, 3),
    "recommend": (0, 1),
    "skill_score": (0, 100),
    "is_original": (0, 1),
    "is_comanaged": (0, 1),
}
AI_TEXT_FIELDS = [
    "manager", "verdict", "skill_reason", "concentration_reason", "hard_thesis",
    "turnover_note", "model", "data_basis", "analyzed_at",
]
AI_FLOAT_FIELDS = ["tenure_years"]

# ---- fixed values: level-1 industry -> broad theme --------------------------------------
INDUSTRY_THEMES = {
    "电子": "泛科技TMT", "通信": "泛科技TMT", "计算机": "泛科技TMT", "传媒": "泛科技TMT",
    "电力设备": "新能源链",
    "有色金属": "周期资源", "基础化工": "周期资源", "钢铁": "周期资源", "煤炭": "周期资源",
    "石油石化": "周期资源", "建筑材料": "周期资源", "公用事业": "周期资源", "环保": "周期资源",
    "交通运输": "周期资源",
    "食品饮料": "大消费", "家用电器": "大消费", "纺织服饰": "大消费", "商贸零售": "大消费",
    "美容护理": "大消费", "社会服务": "大消费", "轻工制造": "大消费", "农林牧渔": "大消费",
    "医药生物": "医药",
    "国防军工": "高端制造", "机械设备": "高端制造", "汽车": "高端制造", "建筑装饰": "高端制造",
    "银行": "金融地产", "非银金融": "金融地产", "房地产": "金融地产",
    "综合": "综合",
    "半导体": "泛科技TMT", "资讯科技器材": "泛科技TMT", "软件服务": "泛科技TMT",
    "电讯": "泛科技TMT", "媒体及娱乐": "泛科技TMT",
    "一般金属及矿石": "周期资源", "原材料": "周期资源", "黄金及贵金属": "周期资源",
    "石油及天然气": "周期资源", "建筑": "周期资源", "工用运输": "周期资源",
    "工用支援": "周期资源", "工业工程": "周期资源",
    "食物饮品": "大消费", "消费者主要零售商": "大消费", "专业零售": "大消费",
    "家庭电器及用品": "大消费", "纺织及服饰": "大消费", "旅游及消闲设施": "大消费",
    "支援服务": "大消费", "农业产品": "大消费",
    "药品及生物科技": "医药", "其他医疗保健": "医药",
    "保险": "金融地产", "其他金融": "金融地产", "地产": "金融地产",
    "综合企业": "综合",
}

# ---- fixed values: period words -> column suffix ---------------------------------------
PERIOD_SUFFIXES = {
    "成立以来": "since_inception", "今年以来": "ytd",
    "近一月": "1m", "近1月": "1m",
    "近三月": "3m", "近3月": "3m",
    "近六月": "6m", "近6月": "6m",
    "近一年": "1y", "近1年": "1y",
    "近三年": "3y", "近3年": "3y",
    "近五年": "5y", "近5年": "5y",
}
RISK_PERIODS = ["1y", "3y", "5y"]
RISK_KEYWORDS = {
    "risk_return_ratio": ["风险收益比"],
    "anti_risk_ratio": ["抗风险"],
    "volatility": ["波动率", "标准差"],
    "sharpe": ["夏普"],
    "max_drawdown": ["最大回撤", "最大回撒"],
}
ACHIEVEMENT_KEYWORDS = {
    "return": ["涨跌幅", "收益率", "区间收益"],
    "rank": ["同类排名", "排名"],
    "drawdown": ["最大回撤", "最大回撒"],
}
BASIC_KEYWORDS = {
    "fund_name": ["基金简称", "基金名称"],
    "fund_full_name": ["基金全称"],
    "establish_date": ["成立时间", "成立日期"],
    "scale": ["最新规模", "资产规模", "基金规模"],
    "fund_company": ["基金公司", "管理人"],
    "fund_manager": ["基金经理"],
    "custodian_bank": ["托管"],
    "fund_type": ["基金类型"],
    "rating_agency": ["评级机构"],
    "fund_rating": ["基金评级", "评级"],
    "invest_strategy": ["投资策略"],
    "invest_target": ["投资目标"],
    "benchmark": ["业绩比较基准", "基准"],
}
HOLD_KEYWORDS = {
    "position_stock": ["股票"],
    "position_bond": ["债券"],
    "position_cash": ["现金"],
    "position_other": ["其他", "其它"],
}

# ---- fixed values: type globs of the night batches --------------------------------------
SYNC_GROUPS = {
    "P1": ["货币型*", "债券型*", "指数型-固收"],
    "P2": ["股票型", "混合型*", "指数型-股票", "Reits", "QDII-REITs", "QDII-港股*", "@REIT", "@QDII_HK"],
    "P3": ["QDII-商品*", "商品*", "FOF*", "QDII-FOF*", "QDII-美股*", "QDII-全球*", "QDII-海外*",
           "@QDII_OVERSEAS"],
}
HK_MARKERS = ["港股", "香港", "恒生", "港币"]

# Sentences of the reconciliation, in their order there. {} is a fund, a sum of money or a similarity.
NOTE_HOLD = "已在目标 ± 缓冲带内，保持不动（抗噪）"
NOTE_NO_MONEY = "低配，但本轮可动用资金已用尽，暂缓补仓"
NOTE_OPEN = "低配，建议建仓「{}」"
NOTE_ADD = "低配，建议加仓「{}」"
NOTE_SHORT = "（资金有限，距目标还差约 {} 元，未完全到位）"
NOTE_TRIM = "超配，减仓（先卖非目标基金）用于补低配赛道"
NOTE_NOT_NEEDED = "超配，但低配已被其它资金补足，本轮暂不减"
NOTE_SWAPPED = "簇内非目标基金已换成目标基金「{}」，总仓位不变"
NOTE_ALSO_SWAPPED = "；并把簇内剩余非目标基金换成「{}」"
NOTE_NO_DATA = "库中无该基金持仓数据，无法归类"
NOTE_OUTSIDE = "不属于本组合任一赛道（最高相似度 {}）"
NOTE_SOLD_OUT = "，清仓用于补低配赛道"
NOTE_SOLD_PART = "，部分卖出用于补低配赛道"
NOTE_KEPT = "，保留不动"
NOTE_KEPT_UNUSED = "，本轮无需动用，保留不动"

# Marks of the front and back end at the end of a fund's name, in either kind of brackets.
SIDE_MARKS = ("（前端）", "（后端）", "(前端)", "(后端)", "（前端)", "（后端)", "(前端）", "(后端）")
