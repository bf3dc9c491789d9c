"""Word lists, thresholds, patterns and lookup tables.

Everything here has to equal the published behaviour for results to agree, so the
values are stated plainly and in natural order.  Code elsewhere only refers to them.
"""

# --- character classes (fixed values) ---------------------------------------
KANJI = "一-龠々"
KANJI_KATA = "一-龠々ァ-ヶ"
HIRAGANA = "ぁ-ん"
KATAKANA = "ァ-ヶ"
JAPANESE = "一-龠ぁ-んァ-ヶ"

# Python's notion of white space and of line ends, as Java classes
SPACE = r"\s\x1c-\x1f"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Code points whose Unicode name marks them as kanji / as kana (fixed values)
KANJI_BY_NAME = (
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FA6D}\x{FA70}-\x{FAD9}"
    r"\x{20000}-\x{2A6DF}\x{2A700}-\x{2B739}\x{2B740}-\x{2B81D}\x{2B820}-\x{2CEA1}"
    r"\x{2CEB0}-\x{2EBE0}\x{2EBF0}-\x{2EE5D}\x{2F800}-\x{2FA1D}\x{30000}-\x{3134A}"
    r"\x{31350}-\x{323AF}\x{1F210}-\x{1F212}\x{1F214}-\x{1F23B}\x{1F240}-\x{1F248}"
)
KANA_BY_NAME = (
    r"\x{3041}-\x{3096}\x{3099}-\x{30FF}\x{31F0}-\x{31FF}\x{32D0}-\x{32FE}"
    r"\x{FF65}-\x{FF9F}\x{1AFF0}-\x{1AFF3}\x{1AFF5}-\x{1AFFB}\x{1AFFD}-\x{1AFFE}"
    r"\x{1B000}-\x{1B001}\x{1B11F}-\x{1B122}\x{1B132}\x{1B150}-\x{1B152}\x{1B155}\x{1B164}-\x{1B167}\x{1F200}-\x{1F202}\x{1F213}"
)
EMOJI = (
    r"\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}"
    r"\x{1F004}-\x{1F0CF}\x{200D}"
)

# --- note syntax (fixed patterns) -------------------------------------------
IMAGE_LINK = r"!\[\[(.*?)(?:\|.*?)?\]\]"
OCR_MARK = r"(?i)\[!ocr\]"
OCR_HEADER = rf"(?iU)>[{SPACE}]*\[!ocr\]"
ANY_CALLOUT = rf"(?U)>[{SPACE}]*\[!"
HEADING = rf"(?U)^#{{1,6}}[{SPACE}]+"
PAGE_HEADING = rf"(?iU)^#{{1,6}}[{SPACE}]+.*\.(jpg|jpeg|png)\b"
WIKILINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
EXCLUDED_DIRS = ("backup", "proofreading-app", ".trash", ".obsidian", ".gemini")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")

# --- tokens (fixed patterns and lists) --------------------------------------
METADATA_SPLIT = rf"(?U)[_\-{SPACE}　・]+"
FRONTMATTER_SPLIT = rf"(?U)[{SPACE}　・、,，]+"
BODY_SPLIT = rf"(?U)[{SPACE}　・、,，。！？「」『』【】〔〕…［］]+"
TOKEN_MIN_LEN = 2
TOKEN_MAX_LEN = 20
METADATA_KEYS = ("title", "collection", "region", "subject", "series")
FRONTMATTER_SKIP_KEYS = (
    "tags", "aliases", "cssclass", "cssclasses", "banner",
    "created", "modified", "updated", "date", "publish",
    "status", "type", "template", "layout",
    "analyzed_status", "ocr_status",
    "id", "uuid", "permalink", "url", "link",
)
BODY_SKIP_LABELS = ("事件名", "原告", "被告", "裁判官", "裁判所", "年月日", "出典", "備考", "典拠")
PARTY_KEYS = ("plaintiff", "defendant", "judge")

# --- bonuses and scores (fixed values) --------------------------------------
PROPER_NOUN_BONUS = 30.0
REGION_ALIAS_BONUS = 20.0
METADATA_BONUS = 15.0
FRONTMATTER_BONUS = 26.0
BODY_BONUS = 15.0
REGIONAL_CAP = 40.0
STANDALONE_CAP = 25.0
STANDALONE_MIN = 20.0
ALIAS_FACTOR = 0.85
DICT_BASE = 100.0
DICT_PER_PRIORITY = 10.0
DOMAIN_BONUS = 20.0
EXPERIMENTAL_FACTOR = 0.8
PROTECT_BONUS = 50.0
SHAPE_SCORE = 50.0
TOP_K = 5
OCR_CONFIDENCE_MIN = 0.6
STALE_DAYS = 180
PROMOTION_MIN_APPROVALS = 3
BULK_KATAKANA_MIN = 0.85
MIN_PREVIEW_MS = 5000

# --- particles (fixed values) -----------------------------------------------
PARTICLE_PAIRS = (
    ("ハ", "は"), ("ニ", "に"), ("ヲ", "を"), ("ノ", "の"),
    ("ト", "と"), ("ヘ", "へ"), ("テ", "て"),
)
NORMALIZED_PARTICLES = (("に", "ニ"), ("を", "ヲ"), ("は", "ハ"))
PARTICLE_PHRASES = (
    "において", "における", "について", "については", "につき", "にて", "にも", "には",
    "をもって", "をめぐって", "をめぐる", "または", "あるいは",
    "はじめ", "はなく", "はもと", "はもちろん",
)
STYLE_SKIP_LINE = r"[。（(「」）)]"
DOMINANCE = 0.70
MIN_PARTICLES = 10

# --- document type (fixed values) -------------------------------------------
CLASSICAL_ERAS = (
    "明治", "大正", "江戸", "慶長", "文久", "安政", "天保", "文政", "寛政", "享保",
    "元禄", "寛永", "元和", "文禄", "天正", "永禄", "天文", "大永", "明応", "延徳",
)
CLASSICAL_MARKS = (
    "ナリ|タリ|ベシ|ケリ|テフ|ヲ以テ|ヲモテ|ニ付|ノコト|ノ義|ノ儀"
    "|ニ係ル|ニ関スル|ニ対シ|候|仕候|申候|右候|以上候|御座候"
)
MODERN_MARKS = (
    "です|ます|ません|ください|について|における|に関して"
    "|した[。\n]|する[。\n]|される|られる|させる|できる"
)

# --- symbol and noise detectors (fixed patterns) ----------------------------
SYMBOL_RUN = "[！？。、…・]{3,}"
ISOLATED_ALNUM = f"([{JAPANESE}])([a-zA-Z0-9])([{JAPANESE}])"
DIGIT_NOISE = "[一〇]{1,6}(?:、[一〇]{1,6}){3,}"
LOW_DIVERSITY_MIN_CHARS = 25
LOW_DIVERSITY_MAX = 0.12

# --- 申立 word forms (fixed values) ------------------------------------------
# (form, verdict, score, reason, image audit, suggestion, its reason, its confidence)
GRAMMAR_RULES = (
    ("申立仕候", "accept", 0.95, "申立仕候：候文謙譲形として正規（高信頼）", False, None, None, None),
    ("申立候", "accept", 0.90, "申立候：候文連用形として正規（標準形）", False, None, None, None),
    ("申立レ共", "review", 0.38, "申立レ共：申立候共 の 候→レ OCR誤変換疑い（要画像確認）", True,
     "申立候共", "候の草書体がレ状に誤認されるパターン（字形類似）", 0.88),
    ("申立レトモ", "review", 0.38, "申立レトモ：申立候トモ の 候→レ OCR誤変換疑い（要画像確認）", True,
     "申立候トモ", "候の草書体がレ状に誤認されるパターン（字形類似）", 0.85),
    ("申立レ", "reject", 0.15, "申立レ：古文書語形として不自然、かつ候→レ OCR誤変換確定", True,
     "申立候", "候の草書体がレ状に誤認されるパターン（字形類似）", 0.90),
    ("申立ル", "reject", 0.25, "申立ル：動詞終止形カタカナ化または候脱落。OCRアーティファクト疑い", True,
     "申立候", "候文では終止形カタカナ表記は通常存在しない。候脱落または候→ル誤変換の可能性", 0.75),
    ("申立テ", "reject", 0.25, "申立テ：カタカナ「テ」は候脱落または而（しこうして）の誤認。OCRアーティファクト疑い", True,
     "申立候", "テは而（而）の誤読または候脱落。文脈によっては申立而も候補", 0.70),
)
GRAMMAR_SCAN = "申立(?:仕候|候|レ共|レトモ|レ|ル|テ)"
ACCEPT_MIN = 0.75
REVIEW_MIN = 0.45
CONFIDENT_ACCEPT = 0.90
# The one soft hint: suspect text, extra candidate, source label (fixed values)
SOFT_HINT = ("わり", "ヨリ", "manual_override_seed")

# --- reasons shown with a span (fixed texts) --------------------------------
REASON_SYMBOLS = "記号の不自然な連続"
REASON_ALNUM = "不自然な英数字の混入"
REASON_LOW_DIVERSITY = "文字の繰り返しノイズ（OCR誤認）"
REASON_DIGITS = "数字記号の繰り返しノイズ（OCR誤認）"
REASON_TERM = "辞書に登録された語彙です"
REASON_VARIANT = "辞書に登録された異表記です (正規化形: %s)"
REASON_HIRAGANA = "カタカナ優勢文書にひらがな「%s」検出 → 「%s」の誤認の可能性（OCRアーティファクト疑い）"
REASON_BIGRAM = "カタカナ優勢文書にひらがな2文字「%s」検出 → 「%s」の誤認の可能性（OCRアーティファクト疑い）"
REASON_PARTY = "フロントマター登録語（確認）"
REASON_PARTY_BROKEN = "フロントマター登録語（改行またぎ・確認）"
VERDICT_PARTY_BROKEN = "フロントマター登録語（改行またぎ）"
REASON_LOW_CONFIDENCE = "OCR信頼度が低い (%.2f)"
VERDICT_ACCEPT_BY_SCORE = "OCR信頼度 %.2f（閾値 0.75 以上: 適正）"
VERDICT_REVIEW_BY_SCORE = "OCR信頼度 %.2f（要確認 0.45–0.75）"
VERDICT_REJECT_BY_SCORE = "OCR信頼度 %.2f（閾値 0.45 未満: 要修正）"

# --- symbol cleanup, applied in this order (fixed patterns) -----------------
CLEANUP_RULES = (
    ("consecutive_square", "連続する □ 記号", "□{2,}"),
    ("symbol_garbage", "記号ゴミ列（・.、の混在）", "[・.、]{3,}"),
    ("consecutive_ellipsis", "連続する … 記号（水平省略記号）", "…{2,}"),
    ("consecutive_dots_wide", "連続する点列（。・…などの混在3文字以上）", "[。・…．｡]{3,}"),
)

# --- line classifier (fixed values) -----------------------------------------
# (id, description, pattern, priority, rule type, weight, category)
LINE_RULES = (
    ("cls_moushisourou", "申候（古文書定型句）", "申候", 90, "include", 0.9, "classical"),
    ("cls_tsukamatsurisourou", "仕候（古文書定型句）", "仕候", 90, "include", 0.9, "classical"),
    ("cls_gozasourou", "御座候（古文書定型句）", "御座候", 90, "include", 0.9, "classical"),
    ("cls_sourounari", "候也（古文書結語）", "候也", 90, "include", 0.9, "classical"),
    ("cls_souroudokoro", "候処（古文書定型句）", "候処", 90, "include", 0.9, "classical"),
    ("cls_sourouaida", "候間（古文書定型句）", "候間", 90, "include", 0.9, "classical"),
    ("cls_kudashioku", "被下（古文書定型句）", "被下", 90, "include", 0.9, "classical"),
    ("cls_oosetsuke", "被仰付（古文書定型句）", "被仰付", 90, "include", 0.9, "classical"),
    ("cls_ooidashi", "被仰出（古文書定型句）", "被仰出", 90, "include", 0.9, "classical"),
    ("cls_subeki", "可被（古文書定型句）", "可被", 90, "include", 0.9, "classical"),
    ("cls_yorinokudannnogotoshi", "仍如件（古文書結語）", "仍如件", 90, "include", 0.9, "classical"),
    ("cls_yorishikashite", "仍而如件（古文書結語）", "仍而如件", 90, "include", 0.9, "classical"),
    ("cls_souin_nashi", "相違無之（古文書定型句）", "相違無之", 90, "include", 0.9, "classical"),
    ("cls_migi_no_toori", "右之通（古文書定型句）", "右之通", 80, "include", 0.8, "classical"),
    ("cls_koreniyori", "依之（古文書接続詞）", "依之", 80, "include", 0.8, "classical"),
    ("cls_sourotomo", "候共（古文書逆接複合句）", "候共", 85, "include", 0.85, "classical"),
    ("cls_iedomo", "雖（雖モ・雖然・雖トモ — 古文書逆接）", "雖", 80, "include", 0.8, "classical"),
    ("cls_womottecu", "ヲ以テ（古文書手段・理由の助詞連語）", "[ヲを]以[テて]", 70, "include", 0.7, "classical"),
    ("cls_moushitate", "申立候/申立ル/申立テ/申立レ共（古文書出訴・動詞語形）",
     "申立(?:候|テ|ツ?ル|レ(?:共|トモ))", 65, "include", 0.65, "classical"),
    ("cls_nitsuki", "ニ付（漢字・カタカナ混用助詞）", "ニ付", 60, "include", 0.6, "classical"),
    ("cls_nite", "ニ而（漢字・カタカナ混用助詞）", "ニ而", 60, "include", 0.6, "classical"),
    ("cls_sourou", "候（古文書敬語語尾）", "候", 50, "include", 0.5, "classical"),
    ("mod_deshita", "でした（現代語過去形）", "でした", 90, "exclude", 0.9, "modern"),
    ("mod_mashita", "ました（現代語過去形）", "ました", 90, "exclude", 0.9, "modern"),
    ("mod_masen", "ません（現代語否定形）", "ません", 90, "exclude", 0.9, "modern"),
    ("mod_deatta", "であった（論文調過去形）", "であった", 80, "exclude", 0.8, "modern"),
    ("mod_datta", "だった（現代語口語過去形）", "だった", 70, "exclude", 0.7, "modern"),
    ("mod_desu", "です（現代語丁寧形）", "です", 80, "exclude", 0.8, "modern"),
    ("mod_masu", "ます（現代語丁寧形）", "ます", 80, "exclude", 0.8, "modern"),
    ("mod_dearu", "である（論文調断定）", "である", 70, "exclude", 0.7, "modern"),
    ("mod_da_weak", "だ（現代語断定・弱指標）", "だ", 30, "exclude", 0.3, "modern"),
    ("pct_kuten", "。（句点・近代文書の弱い指標）", "。", 30, "exclude", 0.3, "punctuation"),
)

# --- regions (fixed lookup tables) ------------------------------------------
REGION_ALIASES = {
    "大阪": ("大阪", "大坂", "浪速", "摂津"),
    "京都": ("京都", "山城", "洛"),
    "奈良": ("奈良", "大和", "大倭"),
    "滋賀": ("滋賀", "近江", "江州"),
    "和歌山": ("和歌山", "紀伊", "紀州"),
    "群馬": ("群馬", "上野", "上州"),
    "長野": ("長野", "信濃", "信州"),
    "山梨": ("山梨", "甲斐", "甲州"),
    "青森": ("青森", "陸奥", "南部"),
    "宮城": ("宮城", "陸前", "仙台"),
    "秋田": ("秋田", "羽後", "出羽"),
    "熊本": ("熊本", "肥後"),
    "静岡": ("静岡", "駿河", "遠江"),
    "愛知": ("愛知", "尾張", "三河"),
    "三重": ("三重", "伊勢", "伊賀", "志摩"),
    "鳥取": ("鳥取", "因幡", "伯耆"),
    "沖縄": ("沖縄", "琉球"),
}
REGION_FILE_KEYS = {
    "北海道": "hokkaido", "青森": "aomori", "岩手": "iwate", "宮城": "miyagi",
    "秋田": "akita", "山形": "yamagata", "福島": "fukushima", "茨城": "ibaraki",
    "栃木": "tochigi", "群馬": "kozuke", "埼玉": "saitama", "千葉": "chiba",
    "東京": "tokyo", "神奈川": "kanagawa", "新潟": "niigata", "富山": "toyama",
    "石川": "ishikawa", "福井": "fukui", "山梨": "yamanashi", "長野": "shinano",
    "岐阜": "gifu", "静岡": "shizuoka", "愛知": "aichi", "三重": "mie",
    "滋賀": "shiga", "京都": "kyoto", "大阪": "osaka", "兵庫": "hyogo",
    "奈良": "nara", "和歌山": "wakayama", "鳥取": "tottori", "島根": "shimane",
    "岡山": "okayama", "広島": "hiroshima", "山口": "yamaguchi", "徳島": "tokushima",
    "香川": "kagawa", "愛媛": "ehime", "高知": "kochi", "福岡": "fukuoka",
    "佐賀": "saga", "長崎": "nagasaki", "熊本": "kumamoto", "大分": "oita",
    "宮崎": "miyazaki", "鹿児島": "kagoshima", "沖縄": "okinawa",
}

# --- table layouts (fixed values) -------------------------------------------
TERM_COLUMNS = (
    "term", "normalized", "variants", "reading", "category",
    "domain", "priority", "protect", "source", "approved",
)
TEMP_TERM_COLUMNS = TERM_COLUMNS + (
    "enabled", "registered_at", "last_seen_at", "note", "approval_count",
)
CORRECTION_COLUMNS = (
    "doc_id", "page", "save_page", "span_id", "occurrence_index",
    "suspect_span", "original_text", "selected_candidate", "candidate_rank",
    "is_manual_input", "time_per_correction", "exported_at", "correction_mode", "cleanup_rule",
)
TRUE_WORDS = ("true", "1", "t", "yes", "y")
FALSE_WORDS = ("false", "0", "f", "no", "n")
DEFAULT_TEMP_FILE = "user_manual_temporary.csv"
USER_ACTION_EVENTS = ("span_rejected", "span_skipped", "manual_selection_corrected")
PLACE_SUFFIX = "[国県郡州道府]$"

# --- sidecar lookup (fixed values) ------------------------------------------
SIDECAR_IMAGE_EXTS = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "gif")
SIDECAR_DATA_EXTS = ("json",)
SIDECAR_LOG_EXTS = ("csv", "log")
SIDECAR_IMAGE_KEYS = ("ocr_image", "image", "source_image")
SIDECAR_DATA_KEYS = ("ocr_data", "ocr_json", "ocr_result")
SIDECAR_LOG_KEYS = ("correction_log", "ocr_log", "log")
SIDECAR_STEPS = ("body-callout", "frontmatter", "basename", "folder-scan")
