"""Word lists, patterns and thresholds. Every function that uses one takes it as an argument."""

# fixed values: regulated wording, by category, in order of categories
CLAIM_WORDS = {
    "medical": ["治疗", "治愈", "疗效", "根治", "消除炎症", "消炎", "抗菌", "杀菌", "灭菌", "抗病毒", "药用", "药效", "处方", "麻醉", "解毒", "抗过敏", "祛痘印", "祛疤", "去疤", "牛皮癣", "湿疹", "皮炎", "激素", "抗生素", "医用", "临床验证", "遵医嘱"],
    "absolute": ["国家级", "世界级", "最高级", "最佳", "最好", "最优", "最有效", "最强", "第一品牌", "全球第一", "全网第一", "独一无二", "唯一指定", "绝无仅有", "100%有效", "百分之百", "永久", "永远", "彻底", "完全去除", "绝不反弹", "零风险", "无副作用"],
    "promise": ["立竿见影", "瞬间", "即刻见效", "一秒", "一分钟", "三天美白", "七天美白", "三天祛斑", "七天祛斑", "一周祛皱", "一夜回春", "无效退款", "无效退全款", "根治", "永不反弹", "一次见效", "永久美白", "永久去皱"],
}
CLAIM_SEVERITY = {"medical": "high", "absolute": "medium", "promise": "medium"}
REVIEW_WORD = "临床验证"
CLAIM_LAW = {"medical": "medical_claim", "promise": "timed_promise", "absolute": "absolute_claim"}
#: law key, where it stands, does it have a published case
LAWS = [
    ("medical_claim", "《化妆品监督管理条例》第三十七条第（二）项", True),
    ("efficacy_claim", "《化妆品监督管理条例》第二十二条", True),
    ("special_category", "《化妆品监督管理条例》第十六条", True),
    ("absolute_claim", "《广告法》第九条", False),
    ("false_ad", "《广告法》第二十八条 / 《反不正当竞争法》第八条", True),
    ("timed_promise", "《广告法》第九条 / 《化妆品监督管理条例》第四十三条", False),
]
#: exposure tiers from the highest, with the law keys of each
TIERS = [("false_ad", ["false_ad"]), ("efficacy", ["medical_claim", "efficacy_claim"]), ("special_category", ["special_category"]), ("wording", ["absolute_claim", "timed_promise"])]
SPECIAL_WORDS = r"(祛斑|美白|防晒|防脱发|防脱|育发|染发|烫发|脱毛|去角质|清洁\s*黑头)"

# fixed values: writing style
AI_MARKERS = ["首先", "其次", "再次", "再者", "此外", "另外", "同时", "综上", "总之", "总而言之", "因此", "由此可见", "值得注意的是", "值得一提", "一方面", "另一方面", "不仅", "而且", "需要指出的是", "总的来说", "换句话说"]
TEMPLATE_MARKERS = ["姐妹们", "宝子们", "集美们", "家人们", "闭眼入", "冲", "绝绝子", "yyds", "无限回购", "亲测有效", "真的绝了", "谁用谁知道", "空瓶", "回购N次", "学生党", "贫民窟", "平替", "天花板", "宝藏", "避雷"]
STYLE_NUMBER = r"[0-9]+(\.[0-9]+)?"
STYLE_TIME = r"(第?[0-9]+[ \t\n]*(天|周|月|年|次|小时|分钟))|(早上|晚上|睡前|晨起|两周|一个月)"
STYLE_SHADE = r"[A-Za-z]*[0-9]{2,3}[ \t\n]*(号|色)?|(色号)|(#[A-Za-z0-9_\p{L}]+)"

#: A text has a match of the two above if, and only if, it has one of these, which need no steps back in texts of words.
STYLE_TIME_SOME, STYLE_SHADE_SOME = r"[0-9][ \t\n]*(?:天|周|月|年|次|小时|分钟)|早上|晚上|睡前|晨起|两周|一个月", r"[0-9]{2}|色号|#[A-Za-z0-9_\p{L}]"
#: And a time has one of these characters.
STYLE_TIME_CHARS = "[天周月年次时钟上前起]"

# fixed values: comments
POSITIVE = ["好", "很好", "不错", "喜欢", "爱了", "推荐", "回购", "好用", "惊艳", "绝绝子", "yyds", "真香", "划重点", "闭眼入", "冲", "不踩雷", "宝藏", "绝了", "封神", "亲妈", "无限回购", "已经回购三次", "空瓶", "囤了", "性价比高", "超出预期"]
NEGATIVE = ["不好", "一般", "失望", "踩雷", "别买", "浪费", "难用", "油腻", "假白", "闷痘", "过敏", "刺痛", "没效果", "智商税", "劝退", "后悔"]
DETAIL = [r"\p{Nd}", r"(天|周|月|年|小时|分钟|早上|晚上|睡前|晨起|去年|今年)", r"(油皮|干皮|混合皮|混油|敏感肌|痘痘肌|中性皮|暗沉|毛孔粗大)", r"(鼻翼|下巴|额头|两颊|法令纹|黑眼圈|毛孔|出油|卡粉|起皮)", r"(上脸|涂上|抹上|推开|吸收|闷|搓泥|假白|不服帖|很润|很干)"]
GRAM, SHORT, NEAR, PAIR_LIMIT, MIN_COMMENTS, CROSS_POSTS = 4, 15, 0.75, 120, 5, 3
FEATURE_WEIGHTS = {"dup_exact_rate": 1.0, "near_dup_rate": 1.2, "short_rate": 0.6, "no_detail_rate": 1.0, "positive_uniformity": 0.9, "template_concentration": 0.8, "burstiness": 0.7}
STRONG = {"dup_exact_rate": 0.30, "near_dup_rate": 0.30, "no_detail_rate": 0.85, "positive_uniformity": 0.90, "template_concentration": 0.50, "burstiness": 0.80}
SUSPICIOUS_SCORE, MATRIX_BONUS = 0.45, 0.25

# fixed values: claims in copy
METRIC_PHOTO = "实拍或未经编辑宣称"
REAL_SHOT = ["实拍", "实物拍摄", "真实拍摄", "原相机", "手机原相机", "现场拍", "当场拍", "本人出镜", "真人出镜", "素颜出镜", "本人实拍", "亲自拍摄", "自己拍的"]
NO_EDIT = ["无滤镜", "没滤镜", "未修图", "没修图", "无P图", "没P过", "没有P过", "原图直出", "原片直出", "直出无修", "无美颜", "零修图", "未经过任何修图", "无任何后期", "没有后期", "素颜原图"]
MARKER_NEGATIONS = ["并非", "并不是", "不是", "没有", "绝非", "非", "不", "没", "未", "不能", "不可", "并不", "不曾"]
DIMENSIONS = {"days": r"([0-9]+(?:\.[0-9]+)?)[ \t\n]*(?:天|日)", "weeks": r"([0-9]+(?:\.[0-9]+)?)[ \t\n]*(?:周|个?星期)", "months": r"([0-9]+(?:\.[0-9]+)?)[ \t\n]*(?:个?月)", "percent": r"([0-9]+(?:\.[0-9]+)?)[ \t\n]*%", "price": r"([0-9]+(?:\.[0-9]+)?)[ \t\n]*(?:元|块|块钱|[rR][mM][bB]|¥)", "volume": r"([0-9]+(?:\.[0-9]+)?)[ \t\n]*(?:[mM][lL]|毫升|[gG]|克)"}

# fixed values: ends of sentences, and what changes a claim's stance
STOPS = "。！？!?；;\n"
QUOTED = r"""「[^」]*」|“[^”]*”|"[^"]*\""""
DENIALS = r"并非|并不|不是|不能|不可|不得|不具备|不具有|不保证|无法|没有|未见|不会|无|不|非"
ACTIONS = r"宣称|提供|起到|用于|治疗|治愈|根治|预防|缓解"
FALSE_TAIL = r"(?:说法|说辞|观点|宣称)(?:并不属实|不属实|不成立|不实|错误|虚假)"
REPORTING = r"声称|宣称|写着|提到|引用|说法|评论|引述|禁止|禁用|辟谣|例如|比如"
UNTRUE = r"不实|不成立|错误|不可信"
DISCLOSED = r"(?:AI|人工智能|生成式)(?:生成|合成|绘制)?\s*(?:示意(?:图)?|效果图|模拟(?:图)?|演示(?:图)?)|(?:示意图|效果图)\s*[（(]?\s*(?:AI|人工智能)(?:生成)?"

# fixed values: what a claim in copy says. Measures: metric, pattern, and which of its groups are what
PRODUCT = r"产品(?:名称)?\s*[:：]\s*([^，,。；;\n]+)|【([^】]*(?:精华(?:液)?|面霜|眼霜|乳液|粉底(?:液)?|口红|唇釉|防晒霜|面膜|洁面乳|化妆水))】"
PERIOD = r"([0-9]+(?:\.[0-9]+)?)\s*(天|日|周)"
EDITION = r"(?<!\d)(?:20\d{2}版|第[一二三四五六七八九十\d]+代|新版|旧版)"
SHADE = r"(?:色号|色號|#)\s*[:：#]?\s*([A-Za-z0-9]+)"
PEOPLE = r"敏感肌|混油皮|混干皮|干皮|油皮|受试者|成年人"
TERMS = r"即时|即刻|首次|连续使用|早晚|夜间|每[日天]|实验室|消费者自评|最高|平均|至少|至多"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
MEASURES = [
    ("水分提升", r"(?:角质层)?(?:水分|含水量|含水率)\s*(?:提升|增加|提高)\s*" + NUMBER + r"\s*(%)", {"value": 1, "unit": 2}),
    ("天然来源比例", NUMBER + r"\s*(%)\s*(?:为|的)?\s*天然来源", {"value": 1, "unit": 2}),
    ("天然来源比例", r"天然来源(?:成分)?(?:比例|占比)?\s*(?:达|为|[:：])?\s*" + NUMBER + r"\s*(%)", {"value": 1, "unit": 2}),
    ("斑点减少", r"(?:色斑|斑点)(?:面积|数量)?\s*(?:减少|下降|降低)\s*" + NUMBER + r"\s*(%)", {"value": 1, "unit": 2}),
    ("保湿时长", r"保湿\s*(?:长达|持续)\s*" + NUMBER + r"\s*(小时|h|天|日)", {"value": 1, "unit": 2}),
    ("保湿时长", NUMBER + r"\s*(小时|h)\s*(?:持久)?保湿", {"value": 1, "unit": 2}),
    ("规格", r"(正装|赠品|小样|试用装)\s*(?:容量|净含量|规格)?\s*[:：]?\s*" + NUMBER + r"\s*(毫升|ml|克|g)", {"variant": 1, "value": 2, "unit": 3}),
]
#: For each measure, words of which a clause that it matches has one.
MEASURE_WORDS = [("水分", "含水"), ("天然来源",), ("天然来源",), ("斑",), ("保湿",), ("保湿",), ("正装", "赠品", "小样", "试用装")]
METRIC_HOURS = "保湿时长"
UNIT_NAMES = {"毫升": "ml", "克": "g", "小时": "h", "日": "天"}
WITHOUT_PERIOD = ["保湿时长", "规格", "天然来源比例"]
PLAIN_EFFECT = r"治愈|治疗|根治|修复|美白|祛斑|抗皱|淡纹|保湿|控油|祛痘"
BEFORE_AFTER = r"(?:真人|本人|实拍|实测|真实拍摄)[^，,。！？!?；;\n]{0,10}(?:前后对比|效果对比|功效对比|使用前后)|(?:前后对比|使用前后)[^，,。！？!?；;\n]{0,10}(?:实拍|真人|本人)"
UNEDITED = r"原相机实拍|原图直出|未修图|无滤镜|实拍"
#: A clause without any of these has no claim, in compatible form or not (the last class is of characters that the form makes ideographs).
CLAIM_HINT = r"水分|含水量|含水率|天然来源|斑点|色斑|保湿|正装|赠品|小样|试用装|色号|色號|[#＃﹟]|治愈|治疗|根治|修复|美白|祛斑|抗皱|淡纹|控油|祛痘|前后对比|效果对比|功效对比|使用前后|实拍|原图直出|未修图|无滤镜|[⺀-⿟豈-﫿㈀-㏿]"

# fixed values: source tracing
OFFICIAL_LINE = r"(官方|品牌|旗舰|企业号|官方素材|素材库|beian|备案)"
WATERMARKS = [r"@([^\s@，,。:：]{1,20})", r"([一-龥A-Za-z0-9_]{1,20})[的の]?(?:小红书|抖音|快手|微博|视频号)", r"^(?:来自)?(.*?)(?:的小红书|的抖音)$"]
SOURCE_CLAIMS = {"brand_official": r"(品牌官方|官方提供|品牌方提供|官方素材|旗舰店|官方图|品牌方素材|官方授权)", "own_shot": r"(原相机|原图直出|实拍|无滤镜|未修图|一手实拍|本人拍摄)", "official_site": r"(官网|官方商城|天猫|京东|官方渠道)"}
BRAND = r"([A-Z][A-Za-z]{2,15})"
CATEGORIES = ["粉底液", "气垫", "粉饼", "散粉", "定妆", "遮瑕", "BB霜", "CC霜", "素颜霜", "面霜", "精华水", "精华液", "原液", "安瓶", "水乳", "乳液", "面膜", "眼霜", "防晒", "口红", "唇釉", "唇膏", "眉笔", "眼影", "腮红", "香水", "身体乳", "护手霜", "喷雾", "洁面", "洗面奶", "卸妆", "膏霜", "乳霜"]

# fixed values: verdicts
LEVELS = ["high_risk", "suspicious", "credible", "inconclusive"]
LIMITS = {"aigc_hard": 0.99, "aigc_high": 0.9, "aigc_abstain": 0.2, "ela": 2.0, "spectral_strong": 0.8, "spectral_gray": 0.6, "edit_high": 0.9, "edit_suspicious": 0.5, "claims_high": 1, "claims_medium": 3}
#: level, what to do, hours until then (null: no limit), must a person look
PLAYBOOK = [("high_risk", "freeze", 2, True), ("suspicious", "hold", 24, True), ("credible", "release", None, False), ("inconclusive", "release_with_note", 48, False)]

#: What the credential tool's output says where the tool is not there, and where there is no manifest.
NO_TOOL = ["找不到 c2patool", "运行 c2patool"]
NO_MANIFEST = ["no claim", "no manifest", "no embedded", "not found", "noclaim", "error", "unable", "no c2pa"]
