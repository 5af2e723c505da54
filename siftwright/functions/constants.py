"""Fixed values that results depend on: names, patterns, marks and limits, stated as they are used."""

from __future__ import annotations

# --- Fixed values: corpora as (file, first language, second language), their domain, and where they may go ---
CORPORA = (
    ("coct.en-zhtw.tsv", "en", "zhtw"), ("ted2020.en-zhtw.tsv", "en", "zhtw"), ("globalvoices.en-zhtw.tsv", "en", "zhtw"), ("kde4.en-zhtw.tsv", "en", "zhtw"),
    ("opensub.en-zhtw.tsv", "en", "zhtw"), ("opus100.en-zh.tsv", "en", "zhtw"), ("ted2020.ja-zhtw.tsv", "ja", "zhtw"), ("opensub.ja-zhtw.tsv", "ja", "zhtw"),
    ("wikimatrix.ja-zh.tsv", "ja", "zhtw"), ("newscomm.ja-zh.tsv", "ja", "zhtw"), ("globalvoices.ja-zhtw.tsv", "ja", "zhtw"), ("kde4.ja-zhtw.tsv", "ja", "zhtw"),
    ("wikimatrix.en-ja.tsv", "en", "ja"), ("ted2020.en-ja.tsv", "en", "ja"), ("jparacrawl.en-ja.tsv", "en", "ja"), ("tatoeba.en-ja.tsv", "en", "ja"),
    ("newscomm.en-ja.tsv", "en", "ja"), ("kftt.en-ja.tsv", "en", "ja"), ("opensub.en-ja.tsv", "en", "ja"), ("mtnt.ja-en.tsv", "en", "ja"),
)
DOMAIN_OF_FAMILY = {"coct": "textbook", "ted2020": "talk", "globalvoices": "news", "kde4": "it", "opensub": "subtitle", "opus100": "web", "wikimatrix": "wiki", "newscomm": "news", "jparacrawl": "web", "tatoeba": "short", "kftt": "wiki", "mtnt": "ugc"}
ONE_WAY = {"opensub.en-ja.tsv": ("ja", "en"), "mtnt.ja-en.tsv": ("ja", "en"), "opensub.en-zhtw.tsv": ("zhtw", "en")}
DOCUMENT_CORPORA = ("ted2020.en-zhtw.tsv", "ted2020.ja-zhtw.tsv", "ted2020.en-ja.tsv", "newscomm.ja-zh.tsv", "newscomm.en-ja.tsv")
DIRECTIONS = (("en", "zhtw"), ("zhtw", "en"), ("en", "ja"), ("ja", "en"), ("ja", "zhtw"), ("zhtw", "ja"))
#: Sources of each direction in order, with their cap (None: no cap). Fixed values.
RECIPES = {
    ("en", "zhtw"): (("coct.en-zhtw.tsv", 50_000), ("globalvoices.en-zhtw.tsv", 35_000), ("ted2020.en-zhtw.tsv", 15_000), ("kde4.en-zhtw.tsv", 12_000), ("opus100.en-zh.tsv", None)),
    ("zhtw", "en"): (("coct.en-zhtw.tsv", 50_000), ("globalvoices.en-zhtw.tsv", 35_000), ("ted2020.en-zhtw.tsv", 15_000), ("kde4.en-zhtw.tsv", 12_000), ("opensub.en-zhtw.tsv", 15_000), ("opus100.en-zh.tsv", None)),
    ("en", "ja"): (("wikimatrix.en-ja.tsv", 35_000), ("jparacrawl.en-ja.tsv", 30_000), ("kftt.en-ja.tsv", 30_000), ("ted2020.en-ja.tsv", 20_000), ("tatoeba.en-ja.tsv", 10_000), ("newscomm.en-ja.tsv", None)),
    ("ja", "en"): (("wikimatrix.en-ja.tsv", 30_000), ("jparacrawl.en-ja.tsv", 25_000), ("kftt.en-ja.tsv", 25_000), ("ted2020.en-ja.tsv", 15_000), ("opensub.en-ja.tsv", 20_000), ("mtnt.ja-en.tsv", None), ("tatoeba.en-ja.tsv", 8_000), ("newscomm.en-ja.tsv", None)),
    ("ja", "zhtw"): (("newscomm.ja-zh.tsv", None), ("globalvoices.ja-zhtw.tsv", 8_000), ("ted2020.ja-zhtw.tsv", 50_000), ("wikimatrix.ja-zh.tsv", 30_000), ("kde4.ja-zhtw.tsv", 12_000), ("opensub.ja-zhtw.tsv", None)),
    ("zhtw", "ja"): (("newscomm.ja-zh.tsv", None), ("globalvoices.ja-zhtw.tsv", 8_000), ("ted2020.ja-zhtw.tsv", 50_000), ("wikimatrix.ja-zh.tsv", 30_000), ("kde4.ja-zhtw.tsv", 12_000), ("opensub.ja-zhtw.tsv", None)),
}
BUDGET, MAX_SHARE, DOC_SHARE, DOC_MIN, DOC_MAX, DEV_PER_DIRECTION, SEED = 130_000, 0.5, 0.15, 4, 16, 200, 42
REPLAY_SHARE, ALIGN_MIN, ALIGN_COVERAGE = 0.35, 0.65, 0.99

# --- Fixed values: instructions by target language, and the system message ---
TEMPLATES = {
    "zhtw": ("翻譯成繁體中文：", "翻譯成臺灣正體中文：", "Translate to Traditional Chinese (Taiwan):", "台湾の繁体字中国語に翻訳してください："),
    "en": ("翻譯成英文：", "Translate to English:", "英語に翻訳してください："),
    "ja": ("翻譯成日文：", "Translate to Japanese:", "日本語に翻訳してください："),
}
SYSTEM_MESSAGE = "You are a professional translator."

# --- Fixed values: character classes and marks ---
KANA = r"\u3040-\u30FF"
HAN = r"\u4E00-\u9FFF\u3400-\u4DBF"
HAN_BASIC = r"\u4E00-\u9FFF"
WIDE = r"\u3000-\u303F\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uFF01-\uFF60"
DELETED = r"[\u0000-\u0008\u000B-\u001F\u007F\u200B-\u200F\u202A-\u202E\u2060\uFEFF]"
TERMINAL = "。．.!?！？」』）)…\"'~～"
LINE_SEPARATORS = r"[\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"

# --- Fixed values: patterns of the row cleaners ---
SPEAKER_IN_PARENTHESES = r"(?U)^\s*[（(][^（）()]{1,25}[）)]\s*"
SPEAKER_TAG = r"(?U)^\s*[A-Z][A-Za-z]{0,10}\s*[:：]{1,2}\s*"
LEADING_DASH = r"(?U)^\s*[-－—]+\s*"
MUSIC = "[♪♫♬]"
PLACEHOLDER = r"(?U)%\d|&[A-Za-z]\b|@[a-z]\w+|\$\{|</?\w[^>]*>"
BLANK_BEFORE_MARK = r"(?U)\s+([,.;:!?%)\]、。，；：！？」』】）])"
BLANK_AFTER_MARK = r"(?U)([(\[「『【（])\s+"
BRACKET_NOTE = r"[\[(][^)\]]{1,30}[)\]]"
FRAGMENT_END = "[,，、;；:：]$"
JA_CONTINUES = "(?:から|けれど|けど|ので|のに|たり|つつ|ながら|ため|とき|こと|もの|[てでがはをにともやしのへ])$"
JA_ENDS = "(?:ます|ません|でした|ましょう|でしょう|ない|[すたるいうえおんかねよなだ])$"
ZH_CONTINUES = "(?:[比跟和與或及而並但把被從對給讓向往於以為因由當若雖則且也都還再又更最就才只]|以及|因為|所以|但是|不過|然後|而且|如果|雖然|由於)$"
STRAY_BLANK = r"[A-Za-z0-9一-鿿][ ]+[_/?=:%&][ ]?|[_/?=][ ]+[A-Za-z0-9一-鿿]"
TRANSLATION_PROMPT = "(?iu)translat|翻譯|翻译|翻訳|译成|譯成|に翻訳"

# --- Fixed values: detectors ---
INVENTED_LABELS = (
    ("label:說明", r"^[ \t]*說明[：:]"),
    ("label:註", r"^[ \t]*(?:註解|註釋|註|備註|注意|提示)[：:]"),
    ("label:問答", r"^[ \t]*(?:問|答|Q|A)[：:]"),
    ("label:譯者", r"^[ \t]*(?:譯者|譯文|翻譯者|翻譯員|譯員)[：:]"),
    ("label:結構", r"^[ \t]*(?:標題|內容|摘要|總結|結論|原文|正文|前言)[：:]"),
    ("label:Note", r"^[ \t]*(?:Note|NOTE|Caption)[：:]"),
    ("enum:數字", r"(?U)^[ \t]*\d{1,2}[.、)]\s"),
    ("figure:圖為", r"^[ \t]*(?:圖為|照片為|圖片為|上圖為|圖說)"),
    ("figure:圖N", r"(?U)^[ \t]*圖\s*\d*\s*[.號：:]"),
    ("select:選擇", r"^[ \t]*選擇[：:]"),
    ("narrate:故事說", r"^[ \t]*(?:故事說|傳說|相傳)[，,]"),
    ("narrate:據報導", r"^[ \t]*(?:據報導|據報道|根據報導|根據報道|報導說|報道稱|據悉)[，,]?"),
)
SOURCE_LABEL = (
    r"(?iuU)^[ \t]*(?:\d{1,2}[.、)]\s|(?:Note|NOTE|Caption|Q|A|Fig(?:ure)?\.?\s*\d*)\s*[：:]|(?:注|注意|説明|説明|図|写真|問|答|キャプション)\s*[：:]"
    r"|說明[：:]|註[：:]|問[：:]|答[：:]|圖\s*\d*\s*[.號：:]|選擇[：:]|(?:It is said that|Legend has it|According to reports|Reportedly|Pictured)|(?:と言われ|によると|伝説))"
)
TAG_PREFIXES = (
    ("label", r"^[ \t]*(?:說明|備註|註解|註|注意|提示|問|答|標題|內容|摘要|總結|結論|原文|譯者|譯文|翻譯|Note|Q|A)[：:]"),
    ("enum", r"(?U)^[ \t]*\d{1,2}[.、)]\s"),
    ("figure", r"(?U)^[ \t]*(?:圖\s*\d*\s*[.號：:]|圖為|照片為|圖片為)"),
    ("select", r"^[ \t]*選擇[：:]?"),
    ("narrate", r"^[ \t]*(?:故事說|據報導|據報道|根據報導|根據報道|報導說|報道稱)"),
)
NAMES = r"(?U)\b(?:[A-Z][a-zA-Z]*[0-9]+[a-zA-Z0-9]*|[A-Z]{2,}[0-9]*|[A-Z][a-z]{2,})\b"
STRICT_NAMES = r"(?U)\b(?:[A-Z]{2,}[0-9]*|[A-Za-z]{1,10}[0-9]+[a-zA-Z]*)\b"
STRICT_STOP = (
    "I", "A", "OK", "TV", "US", "UK", "UN", "AM", "PM", "MR", "DR", "AND", "THE", "OF", "IN", "TO", "IS", "IT", "NO", "ON", "OR", "SO", "BE",
)
NAME_STOP = (
    "The", "This", "That", "These", "Those", "There", "Then", "They", "Their", "And", "But", "For", "You", "Your", "Our", "His", "Her", "Its", "She",
    "One", "When", "What", "Where", "Which", "While", "With", "Who", "Why", "How", "After", "Before", "All", "Any", "Are", "Can", "Did", "Does",
    "Each", "Even", "Every", "From", "Had", "Has", "Have", "Here", "However", "Into", "Just", "Like", "Many", "May", "More", "Most", "Not", "Now",
    "Only", "Other", "Some", "Such", "Than", "Was", "Were", "Will", "Would", "Should", "Could", "Also", "Because", "Been", "Being", "Between",
    "Both", "During", "Under", "Over", "Same", "Since", "Still", "Thus", "Too", "Very", "Well", "Yes", "Yet",
)
YEARS_WIDE, YEARS_NARROW = r"(?:1[89]|20)\d{2}", r"(?:19|20)\d{2}"
#: Characters that simplification merged but that are standard in Taiwan. Fixed values.
TAIWAN_VARIANTS = "群里吃秘床峰游托准干伙岩后征采痴斗台杰划岳皂唇占雇佣栗筑灶丑朴"

# --- Fixed values: gate limits, search limits, benchmarks ---
LEAK_TOLERANCE, SCORE_BAND, BENCH_TOLERANCE, TAIL_MIN, TRUNCATED_MAX, MERE_TRANSLATION_MAX = 0.3, 0.5, 3.0, 0.80, 5.0, 5.0
SEARCH_LEAK_TOLERANCE, SEARCH_DROP_TOLERANCE = 0.3, 1.5
BENCHES = ("flores", "ntrex", "wmt22", "alt", "tico19")
SIMPLIFIED_BENCHES = ("wmt22", "alt", "tico19")
TOKEN_BUDGET, MAX_LENGTH = 1450, 1408
#: Names of the Chinese target in a prompt's head.
CHINESE_TARGETS = ("繁體", "Traditional", "繁体字")
