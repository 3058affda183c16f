"""The survey profile: column layout, codebooks, option lists, rules and model specs.

Nothing in the operators is tied to this survey.  The profile is plain data; the
``*_table`` functions turn it into small DataFrames that operators broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def c(i: int) -> str:
    """Variable code of a 1-based column number."""
    return f"C{i:03d}"


def cols(*spans) -> list[str]:
    """Variable codes for numbers and inclusive (lo, hi) spans, in order."""
    out: list[str] = []
    for s in spans:
        lo, hi = s if isinstance(s, tuple) else (s, s)
        out.extend(c(i) for i in range(lo, hi + 1))
    return out


N_RAW, N_CODED = 64, 108
CODES = cols((1, N_CODED))
NUMERIC = cols((1, 107))

PERCEPTION = cols((52, 63), 65)
IMPORTANCE = cols((66, 75))
PERFORMANCE = cols((76, 85))
COGNITION = cols((86, 89))
MOTIVE = cols((16, 23))
PROJECTS = cols((92, 100))
PROMOS = cols((101, 107))
LIKERT_ALL = cols((52, 89))
SCALE_ITEMS = PERCEPTION + IMPORTANCE + PERFORMANCE + COGNITION
VISITED_BLOCK = cols((33, 42))
UNVISITED_BLOCK = cols((43, 51))
KEY_ITEMS = cols((1, 8), (52, 91))
STRAIGHT_BLOCKS = [cols((52, 63)), cols((66, 85))]
SINGLES = cols((1, 8), 24, 25, 90, 91)
MULTI_SPANS = [(9, 15), (16, 23), (26, 32), (33, 42), (43, 51), (92, 100), (101, 107)]
MULTIS = cols(*MULTI_SPANS)
MCA_ITEMS = cols((1, 8), 90, 91)
CROSS_PAIRS = [(c(8), c(x)) for x in (6, 7, 90, 91, 24, 25)]

# Names of the reported reliability blocks.
RELIABILITY_BLOCKS = {
    "感知维度(52-63,65)": PERCEPTION,
    "重要度维度(66-75)": IMPORTANCE,
    "表现维度(76-85)": PERFORMANCE,
    "认知维度(86-89)": COGNITION,
    "综合量表(52-63,65,66-85,86-89)": SCALE_ITEMS,
}

FLAG_UNION = [
    "duration_lt90_flag", "severe_straightline_flag", "attention_conditional_flag",
    "logic_branch_flag", "key_missing_flag", "open_gibberish_flag", "duplicate_flag",
]
LEGACY_FLAGS = ["attention_flag", "logic_flag", "duplicate_legacy_flag", "straightline_flag"]
SCORES = ["perception_mean", "importance_mean", "performance_mean", "cognition_mean"]
COUNTS = ["motive_count", "new_project_pref_count", "promo_pref_count"]

# Markers used in the raw sheet.
SKIP_TOKEN = "(跳过)"
OTHER_LABEL = "其他"
MULTI_SEPARATOR = "┋"
NO_TEXT = "无"
ATTENTION_LABEL = "完全不同意"
LABEL_YES, LABEL_NO = "是", "否"
STRUCTURAL_MISSING = -3

# Question block names by column span.
BLOCKS = [
    (1, 8, "基础特征与认知"),
    (9, 15, "知晓渠道（多选）"),
    (16, 23, "到访动机（多选）"),
    (24, 24, "停留时长"),
    (25, 25, "消费金额"),
    (26, 32, "体验/消费项目（多选）"),
    (33, 42, "到访问题感知（分支多选）"),
    (43, 51, "未到访原因（分支多选）"),
    (52, 65, "街区感知评价（Likert）"),
    (66, 75, "重要度评价（Likert）"),
    (76, 85, "满意度/表现评价（Likert）"),
    (86, 89, "文化认知与学习意愿（Likert）"),
    (90, 90, "到访意愿"),
    (91, 91, "推荐意愿"),
    (92, 100, "新增项目偏好（多选）"),
    (101, 107, "优惠活动偏好（多选）"),
    (108, 108, "开放题"),
]

# Item types by column span; other columns are "多选/二元".
ITEM_TYPES = [
    (1, 8, "单选"), (24, 25, "单选"), (90, 91, "单选"),
    (52, 89, "Likert(1-5)"), (108, 108, "文本"),
]
ITEM_TYPE_DEFAULT = "多选/二元"

# Fixed values: (rank, lo, hi, use); uses of one column are joined in rank order.
MODEL_USES = [
    (1, 1, 8, "描述统计"), (1, 24, 25, "描述统计"), (1, 90, 91, "描述统计"),
    (2, 1, 8, "交叉分析"), (2, 24, 25, "交叉分析"), (2, 90, 91, "交叉分析"),
    (3, 52, 89, "信效度"),
    (4, 52, 65, "Logit"),
    (5, 66, 75, "IPA-重要度"), (5, 76, 85, "IPA-表现"), (5, 86, 89, "MCA"),
    (6, 86, 89, "Logit"),
    (7, 16, 23, "描述统计"), (7, 92, 107, "描述统计"),
    (8, 66, 85, "聚类"), (8, 16, 23, "聚类"), (8, 92, 107, "聚类"),
    (9, 64, 64, "质控-注意力题"),
    (10, 108, 108, "仅记录(本批次无有效文本)"),
]
MODEL_USE_DEFAULT = "描述统计"

# Missing-data rule texts.
MISSING_RULES = [(33, 51, "-3为结构缺失（Q8分支不适用）"), (108, 108, "文本题；本批数据均为“无”")]
MISSING_RULE_DEFAULT = "空值/异常编码记缺失"

# Option lists of the multiple-choice questions, in column order.
OPTIONS = {
    "Q9": [
        "社交媒体（抖音、小红书、微信、微博等）", "旅游平台（携程、美团等）", "亲友/同事推荐",
        "线下门店/街区路过发现", "新闻/公众号推文", "电视/广播", "其他",
    ],
    "Q10": [
        "了解中医药文化、学习相关知识", "体验中医药非遗项目", "打卡休闲、品尝特色美食 / 养生茶饮",
        "购买中医药文创、保健品及药食同源产品", "慕名而来（叶开泰品牌吸引力）", "体验中医健康调理服务",
        "陪同家人 / 朋友", "其他",
    ],
    "Q13": [
        "中医药诊疗/理疗服务", "中医药文化参观/研学", "药膳/养生餐体验",
        "药食同源产品购买（如黑芝麻丸、养生茶饮等）", "中药材/文创产品购买",
        "主题活动/课程参与（如八段锦、太极拳、香囊制作等）", "其他",
    ],
    "Q14": [
        "无（未遇到任何问题）", "非遗体验项目排队时间过长、体验感不佳",
        "工作人员专业度不足（不熟悉中医药知识、服务态度一般）",
        "配套设施不完善（休息区少、卫生间不便、停车位不足等）",
        "中医药文化展示/讲解不够详细、缺乏吸引力", "美食/文创/保健品价格偏高、品质不符预期",
        "街区环境整洁度不足、卫生状况有待改善", "指示标识不清晰（找不到景点、体验区等）",
        "交通不便", "其他",
    ],
    "Q15": [
        "不够了解街区特色 / 首次听说", "对中医药文化、非遗项目兴趣不大", "距离较远、交通不便",
        "没有合适的时间", "认为街区缺乏吸引力", "消费预算考虑", "已有替代目的地",
        "担心体验感不佳（如项目单一、服务差等）", "其他",
    ],
    "Q22": [
        "中医药主题沉浸式研学营", "时令节气养生体验活动", "非遗中药炮制技艺体验课", "药膳食疗定制服务",
        "中医药健康管理私人顾问", "中医药科普互动课堂（如药材辨识、养生讲座）",
        "传统功法体验（如八段锦、太极拳深度学习）", "中医药主题文化节、展演活动", "其他",
    ],
    "Q23": [
        "产品/服务折扣券", "餐饮套餐优惠", "会员积分 / 储值福利", "节假日限定活动",
        "联名周边 / 伴手礼赠送", "团购 / 家庭套票", "其他",
    ],
}

# Raw column (1-based) and first target column of every multiple-choice question.
MULTI_SOURCES = {
    "Q9": (15, 9), "Q10": (16, 16), "Q13": (19, 26), "Q14": (20, 33),
    "Q15": (21, 43), "Q22": (62, 92), "Q23": (63, 101),
}

# Label -> code books of the single-choice questions, by raw column.
SINGLE_BOOKS = {
    7: {"男": 1, "女": 2},
    8: {"18岁以下": 1, "26-45岁": 2, "18-25岁": 3, "46-64岁": 4, "65岁及以上": 5},
    9: {"初中及以下": 1, "中专/高中": 2, "大专": 3, "本科": 4, "硕士及以上": 5},
    10: {
        "学生": 1, "企业/公司职员": 2, "公务员/事业单位人员": 3, "事业单位人员/公务员": 3,
        "自由职业者": 4, "个体经营者": 5, "服务业从业者": 6, "离退休人员": 7, "其他": 8,
    },
    11: {"3000元以下": 1, "3001-5000元": 2, "5001-8000元": 3, "8001-15000元": 4, "15000元以上": 5},
    12: {"经常（每月≥3次）": 1, "偶尔（每月1-2次）": 2, "很少（每年几次）": 3, "从不": 4},
    13: {"非常了解": 1, "比较了解": 2, "一般": 3, "不太了解": 4, "完全不了解": 5},
    14: {"是": 1, "否": 2},
    17: {"1小时以内": 1, "1-2小时": 2, "2-3小时": 3, "3小时以上": 4},
    18: {"100元以内": 1, "101-300元": 2, "301-500元": 3, "501-1000元": 4, "1000元以上": 5},
    60: {"非常不愿意": 1, "不愿意": 2, "一般": 3, "愿意": 4, "非常愿意": 5},
    61: {"一定不会": 1, "可能不会": 2, "不确定": 3, "可能会": 4, "一定会": 5},
}
SINGLE_TARGETS = {7: 1, 8: 2, 9: 3, 10: 4, 11: 5, 12: 6, 13: 7, 14: 8, 17: 24, 18: 25, 60: 90, 61: 91}

# Likert books; (first raw column, last raw column, first target column, labels 1..5).
LIKERT_BOOKS = [
    (22, 35, 52, ["完全不同意", "不同意", "不一定", "同意", "完全同意"]),
    (36, 45, 66, ["非常不重要", "不重要", "一般", "重要", "非常重要"]),
    (46, 55, 76, ["很不满意", "不满意", "一般", "满意", "很满意"]),
    (56, 59, 86, ["非常不认同", "不认同", "一般", "认同", "非常认同"]),
]

# Question texts of the 108 coded columns.
_RATED = [
    "①丰富的中医药文化展示和非遗体验项目", "②环境舒适度与卫生状况", "③便捷的交通、充足的停车位",
    "④亲友推荐/正面评价多", "⑤特色美食、文创产品的种类及品质", "⑥提供个性化中医体质辨识、养生咨询等服务",
    "⑦服务专业度与态度", "⑧产品价格与优惠力度", "⑨中医药服务专业度", "⑩线上线下宣传推广",
]
ITEM_TEXTS = [
    "1. 您的性别是?（单选）", "2. 您的年龄段是?（单选）", "3. 您的教育程度是?（单选）", "4. 您的职业是?（单选）",
    "5. 您的月收入范围是?（单选）", "6. 您平时是否有购买中医药保健品、养生茶饮或接受中医调理的习惯?（单选）",
    "7. 您对“中医药+文旅”融合模式的了解程度是?（单选）",
    "8. 您是否听说或到访过武汉“叶开泰中医药文化街区” ?（单选）",
    *OPTIONS["Q9"], *OPTIONS["Q10"],
    "11. 您在街区的停留时长大约是?（单选）", "12. 您本次在街区的消费金额大约是?（单选）",
    *OPTIONS["Q13"], *OPTIONS["Q14"], *OPTIONS["Q15"],
    "① 中医药文化的专业性与体验深度（艾灸、推拿等）",
    "② 非遗项目的独特性与参与感（如中医养生锤、草本饮品的学习与制作等）", "③ 非遗传承人互动体验机会",
    "①体验特色药膳 / 药食同源产品", "②产品丰富度与独特性", "③消费价格合理性",
    "① 交通便利性与停车便利", "② 环境舒适度与文化氛围", "③ 配套设施完善度（休息区、卫生间等）",
    "④ 周边配套（购物、其他景点联动）", "①宣传推广的真实性（无夸大宣传）", "②品牌知名度与口碑",
    "③该题请选择“完全不同意”", "④小红书/抖音等线上宣传种草",
    *_RATED, *_RATED,
    "①我对中医药文化（尤其是叶开泰文化街区所传承与展现的文化内涵）非常感兴趣",
    "②在游览叶开泰文化街区前，我对“中医药+文旅”模式非常了解",
    "③游览叶开泰文化街区可以提升我对“中医药+文旅”模式的理解",
    "④我非常愿意学习和了解中医药文化的相关知识与技艺",
    "20. 若有机会，您是否愿意前往叶开泰中医药文化街区游览?（单选）",
    "21. 您是否会向亲友推荐叶开泰中医药文化街区?（单选）",
    *OPTIONS["Q22"], *OPTIONS["Q23"],
    "24. 关于叶开泰“药食同源”产品（如黑芝麻丸、养生茶饮、膏方等），您有哪些看法和建议?（如口感、包装、价格、购买意愿等）",
]

# Score field names, labels, meanings and the models that use them.
FIELD_MAP = [
    ("Q2_age_code", "年龄段（Q2编码）", "受访者年龄序位编码", "Logit"),
    ("Q6_habit_code", "中医药消费习惯（Q6编码）", "是否有中医药相关消费习惯", "Logit"),
    ("Q7_knowledge_code", "融合模式了解程度（Q7编码）", "对中医药+文旅了解程度", "Logit"),
    ("Q8_visit_status_code", "街区认知/到访状态（Q8编码）", "是否听说或到访叶开泰街区", "Logit"),
    ("perception_mean", "感知评价均值", "感知维度（52-63,65）平均得分", "Logit/聚类"),
    ("importance_mean", "重要度均值", "重要度维度（66-75）平均得分", "IPA/聚类"),
    ("performance_mean", "表现度均值", "表现维度（76-85）平均得分", "IPA/Logit/聚类"),
    ("cognition_mean", "文化认知均值", "认知维度（86-89）平均得分", "Logit/聚类"),
    ("motive_count", "到访动机数量", "到访动机多选项勾选总数（16-23）", "Logit/聚类"),
    ("new_project_pref_count", "新增项目偏好数量", "新增项目偏好多选勾选总数（92-100）", "聚类"),
    ("promo_pref_count", "优惠活动偏好数量", "优惠活动偏好多选勾选总数（101-107）", "聚类"),
]

# The base logit: feature name -> source column.
LOGIT_FEATURES = {
    "Q2_age_code": c(2), "Q6_habit_code": c(6), "Q7_knowledge_code": c(7), "Q8_visit_status_code": c(8),
    "perception_mean": "perception_mean", "performance_mean": "performance_mean",
    "cognition_mean": "cognition_mean", "motive_count": "motive_count",
}
LOGIT_CORE, LOGIT_MEDIATOR = c(88), "y_q20_high"
LOGIT_CONTROLS = cols((1, 5), 8)
# (model id, scope text, target, mediator included)
LOGIT_MODELS = [
    ("M1_Q20_visit_intent", "模型1_Q20游览意愿", "y_q20_high", False),
    ("M2_Q21_recommend_direct", "模型2_Q21推荐意愿_不含Q20", "y_q21_high", False),
    ("M3_Q21_recommend_with_q20", "模型3_Q21推荐意愿_含Q20链路", "y_q21_high", True),
]

# Quadrant labels keyed by (importance high, performance high).
IPA_QUADRANTS = {
    (True, True): "Q1_优势区", (False, True): "Q2_维持区",
    (False, False): "Q3_机会区", (True, False): "Q4_改进区",
}
IPA_PRIORITY = IPA_QUADRANTS[(True, False)]
MCA_QUADRANTS = {
    (True, True): "高认知_高意愿", (False, True): "低认知_高意愿",
    (False, False): "低认知_低意愿", (True, False): "高认知_低意愿",
}
# Segment names, in the order they are handed out.
CLUSTER_NAMES = ["文化深度体验型", "价格优惠敏感型", "品质稳定复游型", "轻度打卡观光型"]
SOFT_SEGMENTS = {"low": "高亲和C1_价格权益型", "high": "高亲和C2_文化深度型", "grey": "灰区_待探索"}

# Sampling design parameters and stratum targets.
SAMPLE_DESIGN = {"population": 13_000_000, "z": 1.96, "p": 0.5, "d": 0.045, "deff": 1.5, "response_rate": 0.85}
STRATUM_TARGETS = [(1, "到访层", 600), (2, "未到访层", 400)]

# External-validity layers; (layer id, name, C008 code or None, [(variable, label, kind)]).
_INTENT = [(c(90), "到访意愿", "ordinal"), (c(91), "推荐意愿", "ordinal")]
VALIDITY_LAYERS = [
    ("all", "全样本对照", None, _INTENT),
    ("visited", "到访层(C008=1)", 1, [
        (c(36), "到访问题-配套设施不完善", "binary"), (c(37), "到访问题-文化展示不够详细", "binary"),
        (c(38), "到访问题-价格偏高", "binary"), (c(40), "到访问题-指示标识不清晰", "binary"), *_INTENT]),
    ("unvisited", "未到访层(C008=2)", 2, [
        (c(44), "未到访原因-兴趣不大", "binary"), (c(47), "未到访原因-缺乏吸引力", "binary"),
        (c(48), "未到访原因-预算考虑", "binary"), *_INTENT]),
]

# Fit-index cut-offs.
FIT_CUTOFFS = [
    ("CMIN/DF", "lt", 3.0), ("RMSEA", "lt", 0.08), ("CFI", "gt", 0.90), ("TLI", "gt", 0.90), ("SRMR", "lt", 0.08),
]

# Keyword rules of the action matrix; (rule no, keyword, owner, window, KPI). First match wins.
ACTION_RULES = [
    (1, "环境舒适度", "运营保障部", "0-2个月", "IPA对应条目表现度提升>=0.15"),
    (2, "美食", "产品与商户管理部", "1-3个月", "相关品类满意度提升>=0.12"),
    (2, "文创", "产品与商户管理部", "1-3个月", "相关品类满意度提升>=0.12"),
    (3, "新增项目需求", "活动策划部", "1-4个月", "新项目参与率>=30%"),
    (4, "优惠机制", "品牌营销中心", "0-2个月", "优惠活动核销率>=20%"),
    (5, "深入游览关键影响因子", "数据运营与用户增长组", "2-5个月", "深度游览转化率提升>=5%"),
]
ACTION_DEFAULT = ("街区运营中心", "0-3个月", "相关指标较基线提升>=10%")
ACTION_DEPENDS = "预算审批+跨部门协同"
SUGGESTIONS = {
    "ipa": ("高重要度低满意：", "纳入季度优先整改清单，配置专项预算和KPI跟踪。"),
    "project": ("新增项目需求集中于：", "优先开发该类中医药文旅产品，做小规模A/B试点后扩容。"),
    "promo": ("优惠机制偏好集中于：", "将高偏好优惠形式与核心产品绑定，提升转化和复游。"),
    "logit": ("深入游览关键影响因子：", "围绕该因子制定分层触达与产品优化策略，作为转化抓手。"),
}
# Hypotheses; (id, text, variable text, terms shown as evidence, model, direction, conclusion).
HYPOTHESES = [
    ("H1", "年龄结构会影响深入游览行为", "Q2_age_code", ["Q2_age_code"], "二元Logit", "双向（不预设）", "需结合分组解释"),
    ("H2", "中医药消费习惯越强，深入游览概率越高", "Q6_habit_code", ["Q6_habit_code"], "二元Logit", "正向", "以实证结果为准"),
    ("H3", "融合模式认知越高，深入游览概率越高", "Q7_knowledge_code/cognition_mean",
     ["Q7_knowledge_code", "cognition_mean"], "二元Logit + MCA", "正向", "认知变量需与其他因子联判"),
    ("H4", "到访状态与深入游览显著相关", "Q8_visit_status_code", ["Q8_visit_status_code"], "二元Logit + 交叉卡方", "正向", "方向与显著性按结果解释"),
    ("H5", "整体感知评价越高，深入游览概率越高", "perception_mean", ["perception_mean"], "二元Logit", "正向", "需与表现度区分讨论"),
    ("H6", "存在显著的游客细分画像", "motive_count/new_project_pref_count/promo_pref_count", [], "二阶聚类", "存在差异", "成立（按当前K=2方案）"),
    ("H7", "高重要度低满意条目构成优先改进区", "Q66-75 vs Q76-85", [], "IPA", "存在Q4条目", "成立（当前识别{n}项优先改进）"),
]
HYPOTHESIS_TEXT_EVIDENCE = {"H6": "见聚类稳定性与画像卡", "H7": "见IPA结果表与阈值敏感性表"}

# --- latent-variable models -------------------------------------------------
FACTORS = {
    "S_service": cols((52, 54), 62, 63, 65),
    "S_environment": cols((58, 61)),
    "S_activity": cols((55, 57)),
    "O_cognition": COGNITION,
}
INTENT = {"R_intent": ["R_visit", "R_recommend"]}
SEM_COLUMNS = [i for items in FACTORS.values() for i in items] + INTENT["R_intent"]
_S = ["S_environment", "S_service", "S_activity"]
_S_PAIRS = [(a, b) for n, a in enumerate(_S) for b in _S[n + 1:]]
_METHOD_PAIRS = [(c(62), c(63)), (c(63), c(65)), (c(62), c(65))]


def _spec(model, measured, paths, covs):
    rows = [(model, f, "=~", i, 1.0 if n == 0 else None) for f, items in measured.items() for n, i in enumerate(items)]
    rows += [(model, y, "~", x, None) for y, xs in paths for x in xs]
    rows += [(model, a, "~~", b, None) for a, b in covs]
    return rows


_ALL_PAIRS = _S_PAIRS + [(s, "O_cognition") for s in _S] + [(s, "R_intent") for s in _S] + [("O_cognition", "R_intent")]
SEM_SPECS = {
    "baseline_current": _spec(
        "baseline_current", FACTORS,
        [("O_cognition", _S), ("R_visit", ["O_cognition"]), ("R_recommend", ["O_cognition"])], _S_PAIRS),
    "legacy_compat_v2": _spec(
        "legacy_compat_v2", FACTORS,
        [("O_cognition", _S), ("R_visit", ["O_cognition"]), ("R_recommend", ["O_cognition"])],
        _S_PAIRS + [("R_visit", "R_recommend")] + _METHOD_PAIRS),
    "intent_partial_v1": _spec(
        "intent_partial_v1", {**FACTORS, **INTENT},
        [("O_cognition", _S), ("R_intent", ["O_cognition", *_S])], _S_PAIRS + _METHOD_PAIRS),
    "cfa_intent_with_method": _spec("cfa_intent_with_method", {**FACTORS, **INTENT}, [], _ALL_PAIRS + _METHOD_PAIRS),
    "cfa_intent_no_method": _spec("cfa_intent_no_method", {**FACTORS, **INTENT}, [], _ALL_PAIRS),
    "intent_obs_rsum_v1": _spec(
        "intent_obs_rsum_v1", FACTORS,
        [("O_cognition", _S), ("R_sum", ["O_cognition", *_S])], _S_PAIRS + _METHOD_PAIRS),
}
# (model, hypothesis, label, outcome, predictor)
_ENV, _SVC, _ACT = "S_environment", "S_service", "S_activity"


def _paths_to_cognition(model, prefix):
    return [(model, f"{prefix}{n}", f"{short} -> O_cognition", "O_cognition", f)
            for n, (short, f) in enumerate([("S_env", _ENV), ("S_service", _SVC), ("S_activity", _ACT)], 1)]


def _paths_to_outcome(model, prefix, outcome):
    return [(model, f"{prefix}{n}", f"{short} -> {outcome}", outcome, f) for n, (short, f) in enumerate(
        [("O_cognition", "O_cognition"), ("S_env", _ENV), ("S_service", _SVC), ("S_activity", _ACT)], 4)]


DIRECT_PATHS = [
    *_paths_to_cognition("legacy_compat_v2", "H"),
    ("legacy_compat_v2", "H4", "O_cognition -> R_visit", "R_visit", "O_cognition"),
    ("legacy_compat_v2", "H5", "O_cognition -> R_recommend", "R_recommend", "O_cognition"),
    *_paths_to_cognition("intent_partial_v1", "NH"),
    *_paths_to_outcome("intent_partial_v1", "NH", "R_intent"),
    *_paths_to_cognition("intent_obs_rsum_v1", "RH"),
    *_paths_to_outcome("intent_obs_rsum_v1", "RH", "R_sum"),
]
# (model, hypothesis, label, (a outcome, a predictor), (b outcome, b predictor))
INDIRECT_PATHS = [
    ("legacy_compat_v2", "H6", "S_env -> O -> R", ("O_cognition", _ENV), ("R_visit", "O_cognition")),
    ("legacy_compat_v2", "H7", "S_service -> O -> R", ("O_cognition", _SVC), ("R_recommend", "O_cognition")),
    ("legacy_compat_v2", "H8", "S_activity -> O -> R", ("O_cognition", _ACT), ("R_recommend", "O_cognition")),
    ("intent_partial_v1", "NH8", "S_env -> O -> R_intent", ("O_cognition", _ENV), ("R_intent", "O_cognition")),
    ("intent_partial_v1", "NH9", "S_service -> O -> R_intent", ("O_cognition", _SVC), ("R_intent", "O_cognition")),
    ("intent_partial_v1", "NH10", "S_activity -> O -> R_intent", ("O_cognition", _ACT), ("R_intent", "O_cognition")),
]


# --- profile tables ---------------------------------------------------------
def codebook_rows() -> list[tuple[int, int, str, int]]:
    """(raw column, target column, label, code) of every single-choice and Likert answer."""
    rows = [(src, SINGLE_TARGETS[src], label, code) for src, book in SINGLE_BOOKS.items() for label, code in book.items()]
    for lo, hi, dst, labels in LIKERT_BOOKS:
        rows += [(src, dst + src - lo, label, k) for src in range(lo, hi + 1) for k, label in enumerate(labels, 1)]
    return rows


def option_rows() -> list[tuple[str, int, int, str]]:
    """(question, raw column, target column, label) of every multiple-choice option."""
    return [(q, src, dst + n, label) for q, (src, dst) in MULTI_SOURCES.items() for n, label in enumerate(OPTIONS[q])]


def codebook_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(codebook_rows(), "src_col int, dst_col int, label string, code int")


def option_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(option_rows(), "question string, src_col int, dst_col int, label string")


def item_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, c(i), t) for i, t in enumerate(ITEM_TEXTS, 1)], "col_idx int, var_code string, item_text string")


def span_table(spark: SparkSession, spans, name: str) -> DataFrame:
    return spark.createDataFrame(list(spans), f"lo int, hi int, {name} string")


def field_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        FIELD_MAP, "english_field string, chinese_label string, business_meaning string, model_scope string")


def cutoff_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIT_CUTOFFS, "metric string, op string, threshold double")


def action_rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTION_RULES, "rule_no int, keyword string, owner string, time_window string, kpi string")
