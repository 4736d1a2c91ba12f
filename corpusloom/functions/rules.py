"""Rules as data: word lists, patterns and weights that operators take as defaults.

All values here are fixed by the behaviour that results have to match.
"""

# File extensions by category.
CATEGORIES = {
    "doc": ["doc", "docx", "wps", "xls", "xlsx", "ppt", "pptx", "pdf", "txt", "md", "rtf", "csv", "html", "htm", "xhtml"],
    "config": ["json", "yml", "yaml", "xml", "properties", "ini", "conf", "cfg", "toml", "env"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "jar", "war"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "svg", "tif", "tiff", "webp"],
}
# Paths that a scan ignores, and rules that an extra rule file may not add.
IGNORED = ["~$*", "*.tmp", "*.temp", ".DS_Store", "Thumbs.db", "*.log", "node_modules/", "target/", "dist/", "build/", "out/", ".git/", ".idea/", "data/"]
REFUSED = ["*.png", "*.jpg", "*.jpeg", "*.gif", "*.bmp", "*.svg", "*.tif", "*.tiff", "*.webp", "*.zip", "*.rar", "*.7z"]
# Names of package parts behind a text, and the least place of the first one.
PACKAGE_PARTS = ["[Content_Types].xml", "docProps/app.xml", "docProps/core.xml", "docProps/custom.xml", "word/document.xml", "word/styles.xml", "_rels/.rels"]
# Document types, first match wins, then by extension.
DOC_TYPES = [
    ("台账清单", ["付款", "节点", "比例", "责任部门"]),
    ("会议纪要", ["会议纪要", "参会人", "会议结论"]),
    ("合同变更", ["合同", "补充协议", "合同外变更"]),
    ("原型说明", ["原型", "prototype", "交互", "工作台"]),
    ("验收文档", ["验收", "acceptance", "可信度", "问题清单"]),
    ("需求文档", ["需求", "requirement", "必须能回答"]),
    ("接口文档", ["接口", "api", "边界"]),
    ("技术方案", ["技术方案", "架构", "design"]),
    ("部署手册", ["部署", "deploy", "install"]),
]
DOC_TYPE_CONFIG = ("配置文件", ["yml", "yaml", "properties", "conf", "ini", "toml", "json", "xml", "env"])
DOC_TYPE_TEXT = ("说明文档", ["md", "txt", "html", "htm"])
DOC_TYPE_OTHER = "其他"
# Tags and what gives them.
TAGS = [
    ("合同", ["合同", "补充协议"]), ("变更", ["变更", "cr-"]), ("原型", ["原型", "prototype", "交互"]), ("付款", ["付款", "比例"]),
    ("验收", ["验收", "acceptance"]), ("风险", ["风险", "无合同依据"]), ("接口", ["接口", "api", "边界"]), ("AI", ["ai", "无资料依据", "证据"]),
]
# Project names and their generic parts.
PROJECT_PHRASE = r"[\p{IsHan}]{2,24}(?:项目|系统|平台)"
PROJECT_SUFFIX = r"(?:项目|系统|平台)$"
PROJECT_SPLIT = r"(?:项目|系统|平台|中心|目录|资料|文档|阶段|相关|材料)+"
GENERIC_WORDS = ["项目", "系统", "平台", "方案", "文档", "说明书", "需求", "设计", "接口", "建设", "管理", "服务", "智慧", "数字", "信息", "数据", "中心", "统一", "一期", "二期", "三期", "测试", "正式", "定稿", "初稿", "模板", "示例"]
TEMPLATE_WORDS = ["模板", "样例", "示例", "demo", "sample", "example", "仅供参考", "参考格式"]
# Endpoint patterns in order of precedence, with the group that holds the value.
ENDPOINTS = [
    ("JDBC_URL", r"(?i)jdbc:[a-zA-Z0-9+]+://[^\s\"'<>\[\]]{5,300}", 0),
    ("URL", r"(?i)https?://[^\s\"'<>\[\]()　-〿＀-￯一-鿿]{5,200}", 0),
    ("REDIS_URL", r"(?i)redis://[^\s\"'<>\[\]]{3,200}", 0),
    ("MQ_URL", r"(?i)amqps?://[^\s\"'<>\[\]]{3,200}", 0),
    ("IP_PORT", r"\b(?!127\.0\.0\.1|0\.0\.0\.0)(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b", 0),
    ("HOST_PORT", r"(?i)(?:host|server|addr(?:ess)?|broker|endpoint)\s*[=:]\s*([a-zA-Z0-9._-]{3,100}(?::\d{2,5})?)", 1),
]
HOST_BLACKLIST = ["true", "false", "null", "none", "localhost", "port", "host", "hostname", "server", "addr", "address", "value", "name", "username", "password", "endpoint", "broker", "url", "path", "key", "token"]
VALUE_MARKERS = ["...", "xxx", "<", ">", "{", "}", "[", "]", "your-", "example", "<host", "<port"]
EXAMPLE_MARKERS = ["示例", "样例", "例子", "例如", "如：", "如:", "举例", "模板", "占位", "演示", "仅供参考", "参考格式", "填写格式", "格式如下", "api 示例", "json 示例", "example", "sample", "demo", "placeholder", "for example"]
REAL_MARKERS = ["生产", "正式", "实际", "部署", "连接", "接入", "服务器地址", "数据库地址", "服务地址", "内网地址", "外网地址"]
REPLACE_MARKERS = ["请替换", "自行填写", "按需修改"]
DOC_DOMAINS = ["repo.maven.apache.org", "maven.apache.org", "docs.spring.io", "plugins.gradle.org", "schema.org", "www.w3.org", "xml.apache.org", "github.com/spring", "search.maven.org", "baidu.com", "google.com", "wikipedia.org", "zhihu.com", "csdn.net", "cnblogs.com", "stackoverflow.com", "microsoft.com", "qq.com", "163.com", "sina.com", "aliyun.com", "tencent.com", "jianshu.com", "juejin.cn", "gitee.com", "localhost", "127.0.0.1", "qlogo.cn", "kdocs.cn", "doc.weixin.qq.com"]
# What is stripped from file names to find versions of a document.
VERSION = r"(?i)[_\-\s]*[Vv]\d+(\.\d+)*"
DATE = r"\b20\d{6}\b|\b20\d{2}-\d{2}-\d{2}\b|\b[01]\d{3,5}\b"
SUFFIXES = ["终版", "定稿", "最终版", "最终", "final", "副本", "copy", "revised", "修订版", "评审版", "发布版", "草稿", "draft", "初稿", "二稿", "三稿", "评审", "送审", "归档", "备份", "backup", "含变更备注", "变更备注", "备注版", "备注"]
LABEL_SUFFIXES = ["终版", "定稿", "最终版", "最终", "final", "副本", "copy", "revised", "修订版", "评审版", "发布版", "草稿", "draft", "初稿", "二稿", "三稿", "含变更备注", "变更备注", "备注版", "备注"]
# Question words.
STOP_WORDS = ["的", "了", "是", "在", "和", "与", "或", "有", "为", "以", "对", "如", "到", "不", "该", "这", "那", "个", "么", "呢", "吗", "把", "被", "会", "能", "要", "可", "都", "就", "也", "但", "而", "从", "于", "上", "下", "中", "内", "外", "请", "问", "什", "怎", "哪", "如何", "什么", "the", "is", "of", "in", "at", "to", "a", "an", "and", "or", "for", "on", "with", "by", "be", "are", "was", "were", "has"]
QUERY_SUFFIXES = ["有哪些", "是什么", "有哪些", "是什么", "请列出", "请说明", "分别是什么"]
REFERENCE_QUESTION = ["模板", "示例", "样例", "参考", "正式", "生产", "部署", "实际", "真实", "服务器地址", "数据库地址"]
NO_ANSWER = ["资料中未找到相关内容", "资料中未找到与问题相关", "未找到相关内容", "没有直接提及", "无法基于给定内容", "无法准确回答", "无法判断"]
RETRYABLE = ["timeout", "timed out", "connection reset", "connection refused", "429", "502", "503", "504", "超时", "连接重置", "连接失败"]
# Facts and strong claims in a draft.
FACTS = [
    r"\b20\d{2}[-/.年](?:0?[1-9]|1[0-2])[-/.月](?:0?[1-9]|[12]\d|3[01])日?\b",
    r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b",
    r"(?i)https?://[^\s)>,，。]+",
    r"(?<![A-Za-z0-9_])\d[\d,]*(?:\.\d+)?\s*(?:万元|元|人民币)(?![A-Za-z0-9_])",
    r"\b[A-Z]{2,}(?:-[A-Z0-9]+)+\b",
]
ASSERTIONS = [r"证明[^，。；;\n]{1,60}", r"不存在[^，。；;\n]{1,60}", r"唯一[^，。；;\n]{1,60}", r"(?:已经|已)(?:确认|存档|生效|清除|完成)[^，。；;\n]{0,60}", r"保持恒定[^，。；;\n]{0,60}"]
PENDING = r"(?i)待确认|待补充|TODO|TBD|未确认"
PENDING_TITLES = ["待确认", "待确认项", "待补充项"]
MOJIBAKE = r"ï¼|ã|â|Ã.|Â."
# Edge weights of the structural graph.
WEIGHTS = {"PROJECT_CONTAINS": 0.9, "IMPORTS": 0.8, "CONTAINS": 0.5, "MENTIONS": 1.0, "RELATED": 0.3, "MENTIONED_IN": 0.3}
# Fixed value: what stands before the graph facts in a question's contexts.
FACTS_HEADER = "【GraphRAG Local 图谱事实】\n"
