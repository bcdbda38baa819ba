"""Word lists, patterns, formats and limits the results depend on."""

from __future__ import annotations

# --- Fixed values: white space as stripped from both ends of a text. ---
WHITE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0         "
    "       　"
)

# --- Fixed values: subjects named in file names, in order of precedence. ---
FILENAME_SUBJECTS = {
    "化学": "chemistry", "数学": "math", "物理": "physics", "语文": "chinese", "英语": "english",
    "生物": "biology", "地理": "geography", "历史": "history", "政治": "politics",
}

# --- Fixed values: subject words in running text, in order of precedence. ---
TEXT_SUBJECTS = {
    "chemistry": (
        "化学 初三化学 初中化学 高考化学 元素 原子 分子 离子 化合物 化学式 化学方程式 反应 置换 分解 化合 复分解 "
        "氧化 还原 燃烧 溶液 溶解度 溶质 溶剂 浓度 金属 非金属 合金 铁 铜 铝 锌 酸 碱 盐 中和 pH 指示剂 盐酸 硫酸 "
        "硝酸 氢氧化钠 碳酸钙 催化剂 质量守恒 摩尔 物质的量 有机 无机 电解 沉淀 过滤 蒸馏 结晶 蒸发 升华 凝华"
    ).split(),
    "physics": "物理 初中物理 高中物理 高考物理".split(),
    "math": "数学 初中数学 高中数学 高考数学 中考数学".split(),
}

# --- Fixed values: grade words, first band hit wins. ---
GRADE_BANDS = {
    "primary_low": "一年级 二年级 三年级 1年级 2年级 3年级".split(),
    "primary_high": "四年级 五年级 六年级 4年级 5年级 6年级".split(),
    "middle": "七年级 八年级 九年级 初一 初二 初三 7年级 8年级 9年级 初中".split(),
}

# --- Fixed values: words that mark study material. ---
STUDY_WORDS = (
    "题 分 解 方程 计算 证明 化简 求值 判断 选择 填空 解答 应用 阅读 理解 分析 论述 实验 观察 归纳 推理 论证 求解 "
    "画 列出 写出 找出 确定 比较 分类 概括 解释 说明 练习 测试 考试 作业 试卷 答题 得分 评卷 知识点 考点 公式 定理 "
    "定义 法则 性质 class exercise homework exam test quiz calculate prove solve equation function graph "
    "一、 二、 三、 1. ① 单元 学期 年级 科目 数学 语文 英语 物理 化学 生物 政治 历史 地理 科学 algebra geometry physics"
).split()
STUDY_SECTION = r"(?:^|\n)\s*(?:一|二|三|四|五|六)\.\s*(?:选择|填空|判断|解答|计算)"
STUDY_MARKS = r"[（(]\s*[1-9][0-9]*\s*分\s*[)）]"
MATH_SYMBOLS = "=×÷±√∞∫πΔ²³∑∏"

# --- Fixed values: names and sizes refused at intake, and the accepted types. ---
SUSPICIOUS_NAME = r"(?i)^(test|untitled|未命名|新建|tmp|temp|sample|demo)[_\-.0-9]"
SMALL_TEXT_EXTENSIONS = [".txt", ".md", ".csv", ".json", ".yaml", ".yml"]
SMALL_FILE_BYTES = 50
SIDECAR_NAME = r"\.(pdf|docx|doc|pptx|ppt|ppsx|xlsx|xls|png|jpg|jpeg|webp|bmp|htm|html)\.txt$"
UPLOAD_EXTENSIONS = (
    ".pdf .docx .xlsx .pptx .doc .ppt .pps .pptm .ppsx .xls "
    ".jpg .jpeg .png .gif .webp .bmp .tiff .tif "
    ".txt .text .log .md .markdown .rst .asciidoc "
    ".json .jsonc .json5 .yaml .yml .toml .csv .tsv .ini .cfg .conf .env .properties "
    ".tex .latex .bib .js .mjs .cjs .ts .mts .cts .jsx .tsx .vue .svelte .py "
    ".java .kt .kts .scala .groovy .gradle .c .h .cpp .cc .cxx .hpp .hh .hxx .cs .go .rs .zig .nim "
    ".swift .m .mm .rb .php .pl .pm .lua .r .jl .dart .hs .clj .cljs .cljc .ex .exs .erl .ml .mli .fs .fsx "
    ".lisp .lsp .scm .rkt .html .htm .xml .svg .css .scss .sass .less .sol .sh .bash .zsh .fish .ps1 .vim "
    ".sql .graphql .gql .proto .cmake .mk .tf .hcl .nginxconf .dockerfile"
).split()
MAX_FILE_BYTES = 100 * 1024 * 1024

# --- Fixed values: document type by extension; PDFs are told apart by their content. ---
EXTENSION_TYPES = {
    "text": ".txt .md .csv .json .yaml .yml .xml .html .htm .py .js .ts .css .log".split(),
    "image": ".jpg .jpeg .png .gif .webp .bmp .tiff .tif .heic".split(),
    "office_docx": [".docx"],
    "office_xlsx": [".xlsx"],
    "office_pptx": [".pptx", ".pptm", ".ppsx"],
    "office_old": [".doc", ".xls", ".ppt", ".pps"],
    "office_other": [".odt", ".rtf"],
}

# --- Fixed values: embedded-object remnants in extracted office text. ---
OLE_REMNANT = (
    r'(?i)(?=[EOHPRTS])(?:EMBED\s+\S+|OBJECT\s+\S+|HYPERLINK\s+"[^"]*"|PAGEREF\s+\S+|REF\s+\S+|TC\s+"[^"]*"'
    r"|SEQ\s+\S+(?:\s+\S+)*)"
)
OLE_LINE = r'(?i)^\s*(?:EMBED\s+\S+|OBJECT\s+\S+|HYPERLINK\s+"[^"]*")\s*$'

# --- Fixed values: HTML parts removed before display. ---
HTML_BLOCKS = ["script", "style", "iframe", "object", "embed"]
HTML_QUOTED_HANDLER = r"""(?i)\s+on\w+\s*=\s*["'][^"']*["']"""
HTML_BARE_HANDLER = r"(?i)\s+on\w+\s*=\s*\S+"

# --- Fixed values: formula and diagram signs. ---
FORMULA = (
    r"[=＝→←⇌↑↓↔⇄⇆↗↘]|[₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎]|\b[A-Z][a-z]?[0-9]{1,4}|[0-9][A-Z][a-z]?\b"
    r"|[A-Z][a-z]?[A-Z0-9]|[αβγδεζηθικλμνξπρστυφχψω]|====|══"
)
FORMULA_OPERATORS = ["=", "＝", "+"]
DIAGRAM = r"[图表][0-9一二三四五六七八九十]"
DIAGRAM_WORDS = "如图 fig. diagram graph figure 所示 示意图 电路图 受力分析 光路 函数图 函数像 坐标系 坐标图".split()
FIGURE_REFERENCE = r"(?i)[图图表示][0-9一二三四五六七八九十\-]|如图|Fig\.\s*[0-9]+|figure\s*[0-9]+|所示|示意图|图[0-9]+"

# --- Fixed values: intents with their trigger words, in order of precedence. ---
INTENT_WORDS = {
    "wifi_connect": "连接wifi 连wifi 连网 上网设置 配置wifi wifi设置 网络设置 连无线 设置网络 换wifi 换网络 更换wifi 切换wifi 换一个wifi".split(),
    "wifi_scan": "扫描wifi 搜wifi 搜网络 扫描网络 搜无线 wifi列表 可用网络 附近wifi 查看wifi".split(),
    "wifi_status": "wifi状态 网络状态 连接状态 当前网络 wifi信息 ip地址 信号强度".split(),
    "wifi_forget": "忘记wifi 删除wifi 移除wifi 取消保存wifi 断开wifi wifi忘记".split(),
    "device_temp": "温度 多少度 烫 散热 发热 cpu温度 设备温度 主板温度 温控".split(),
    "device_status": "设备状态 系统状态 运行状态 设备信息 状态检查 状态查询".split(),
    "storage_info": "存储 空间 磁盘 硬盘 满了 还剩 存储空间 剩余空间 磁盘空间 内存".split(),
    "ssd_health": "ssd 固态 硬盘寿命 磁盘健康 ssd健康 硬盘健康 磨损 寿命".split(),
    "device_alerts": "告警 报警 异常 故障 问题 设备告警 系统告警".split(),
    "device_cleanup": "清理 释放空间 腾空间 清垃圾 设备清理 系统清理 清理缓存".split(),
    "get_bot_qrcode": "加孩子 绑定孩子 子网关 孩子绑定 添加孩子 孩子二维码 绑定二维码".split(),
}

# --- Fixed values: question numbers written in Chinese numerals. ---
NUMERALS = "一 二 三 四 五 六 七 八 九 十 十一 十二 十三 十四 十五 十六 十七 十八 十九 二十".split()

# --- Fixed values: places where an explanation states the right answer, in order of trust. ---
ANSWER_LETTER = [
    r"正确答案[是为：:]\s*([A-D])",
    r"(?:所以|因此)选\s*([A-D])",
    r"选\s*([A-D])\s*(?:项|符合题意|正确|择)",
    r"应\s*选\s*([A-D])",
    r"([A-D])\s*项\s*(?:符合题意|正确|是正确答案)",
    r"([A-D])\s*选\s*项\s*(?:正确|符合题意)",
]
ANSWER_NUMBER = [
    r"正确答案[是为：:]\s*(-?\d+(?:\.\d+)?)",
    r"所以答案[应是]+\s*(-?\d+(?:\.\d+)?)",
    r"答案是\s*(-?\d+(?:\.\d+)?)",
    r"(?:等于|结果为|求得|得到|算出)\s*(-?\d+(?:\.\d+)?)",
]
ANSWER_TEXT = [
    r"正确答案[是为：:]\s*(.+?)(?:[。.，,\n]|$)",
    r"所以答案[应是]+\s*(.+?)(?:[。.，,\n]|$)",
    r"答案[是为：:]\s*(.+?)(?:[。.，,\n]|$)",
    r"(?:等于|结果为|求得|得到|算出)\s*(\d+)",
    r"=(\d+)(?:[。.，]?\s*[。.！？!?\n]|\s*$)",
]

# --- Fixed values: trailing units ignored, and terms that show the idea of an answer. ---
ANSWER_TAIL = r"[.。，,、\s单位个只条约根种]+$"
KEY_TERMS = "加 减 乘 除 等于 大 小 正 负 数 和 差 积 商 解 方程 分式 分子 分母 倒数 绝对 平方 根".split()

# --- Fixed values: lines that are no title, and words that make one. ---
TITLE_PAGE_LINE = r"^[-─═━]{2,}\s*第?\d+\s*页\s*[-─═━]{0,}$"
TITLE_NOISE = r"^(考试时间|满分|可能用到的|注意事项|答题前|请用|考生|第[ⅠⅤⅣⅢⅡⅠ]|（|\(|本大题|每小题|可能用|注：|注意)"
TITLE_QUESTION = r"^\d{1,2}[\.、．\)]\s*"
TITLE_OPTION = r"^[A-F][\.、．\s]"
TITLE_MEASURES = r"\d+(?:\.\d+)?\s*[℃°]|\d+\s*cm\s*[~～]\s*\d+\s*cm|\d+%"
TITLE_SENTENCE = r"[?？。]|上升|下降|增加|减少|导致|根据|下列"
TITLE_WORDS = r"考试|试卷|测试|试题|入学|招生|统[一考]|期中|期末|模拟|毕业|中考|高考|竞赛"
TITLE_LAST_RESORT_SKIP = r"\d+(?:\.\d+)?\s*[℃°]|\d+%|cm\s*[~～]"

# --- Fixed values: question starts and parts of a paper. ---
QUESTION_START = r"^\s*(?:\d{1,3}[．.、]\s|[（(]\s*\d{1,3}\s*[）)]|[一二三四五六七八九十]{1,2}[、．.]\s)"
CHOICE_OPTION = r"^\s*[A-Da-d][．.、]\s|^\s*[（(]\s*[A-Da-d]\s*[）)]"
BLANK = r"_{2,}|…{2,}"
QUESTION_MARKS = r"[（(]\s*(\d+)\s*分\s*[）)]"
SOLUTION_PREFIX = r"^(?:解:|证明:|解：|证明：)"
PAPER_SUBJECTS = {"数学": "math", "物理": "physics", "化学": "chemistry", "语文": "chinese", "英语": "english", "生物": "biology"}
PAPER_GRADE = r"(七|八|九|高一|高二|高三|初[一二三]|高[一二三])\s*(?:年级|年)?"
PAPER_KINDS = {
    "期中": "midterm", "期末考试": "final", "期末": "final", "月考": "monthly", "模拟": "mock",
    "中考": "zhongkao", "高考": "gaokao", "一模": "mock1", "二模": "mock2",
}
PAPER_YEAR = r"(20\d{2})"
PAPER_MINUTES = r"(\d+)\s*分钟"
PAPER_TOTAL = r"(?:满分|总分)[：:]\s*(\d+)"

# --- Fixed values: question type aliases. ---
QUESTION_TYPES = {
    "choice": "choice multiple_choice multiple-choice mcq".split(),
    "concept": "concept true_false true-false tf judgement".split(),
    "fill_in_blank": "fill_in_blank fill-in-the-blank fill_in_the_blank cloze".split(),
    "short_answer": "short_answer short-answer".split(),
    "written": "written open_ended open-ended open_response open-response essay".split(),
    "coding": "coding code programming".split(),
}

# --- Fixed values: scene word groups with their weight, the threshold, and device words that override. ---
SCENE_GROUPS = {
    "practice": [
        ("出题 做题 刷题 练习题 测验 考试 题目 批改 错题 解题 求解 答案 对错 步骤 运算 因式分解 解方程 计算 证明 几何 函数".split(), 2)
    ],
    "reading": [
        ("教材 课本 阅读 看书 学习资料 课程 章节 可视化 图表 画图 概念图 思维导图 解释概念 什么是 讲解 原理 定义".split(), 2)
    ],
}
SCENE_THRESHOLD = 3
DEVICE_WORDS = (
    "温度 多少度 烫 散热 发热 存储 空间 磁盘 硬盘 满了 还剩 ssd 寿命 磨损 固态 wifi wi-fi 网络 连网 无线 扫描wifi "
    "扫描网络 搜wifi 搜网络 搜无线 设备状态 系统状态 运行状态 ip 信号 清理 释放 腾空间 加孩子 绑定孩子 子网关"
).split()

# Words of a text that tell the type of its figure.
FIGURE_SHAPES = ("三角形", "circle", "圆", "矩形", "正方形", "平行", "垂直", "∠", "△", "▱", "□")
FIGURE_WORDS = ("图", "diagram", "chart", "实验", "示意")
