"""The two graded panels as rule tables: (rule_id, lang, [(kind, *args), ...]); kinds are those of graders.check.

Fixed values: what each item asks for, in the panels' order, thirty items a language.
"""

from __future__ import annotations

YES_MARKS = ("？", "?")

# --- Fixed values: instruction following ---
_ZHTW = [
    [("list_of", "、", 3)],
    [("occurs", "。", 2), ("ends", "。")],
    [("exact", "台北", "臺北")],
    [("lacks", "咖啡"), ("chars", 21, "")],
    [("chars", 6, 50), ("traditional",), ("han",)],
    [("occurs", "->", 2), ("one_line",)],
    [("exact", "7")],
    [("lines", 3), ("each_line_chars", "", 6)],
    [("lacks_match", "[，。、！？；：,.!?;:]"), ("chars", 6, "")],
    [("starts", "答案是"), ("contains_any", "12", "十二")],
    [("exact_without_blanks", "1,2,3,4,5")],
    [("json_keys", "city", "country")],
    [("lacks_match", r"(?U)\d"), ("chars", 21, "")],
    [("chars_without", "[，。、！？；：]", 10, 10)],
    [("list_of", "、", 3), ("occurs_raw", "你好", 3)],
    [("exact", "是")],
    [("lacks", "的"), ("chars", 11, ""), ("han",)],
    [("starts", "台灣", "臺灣"), ("ends_without", "。！", "島")],
    [("ends", *YES_MARKS), ("chars", 6, "")],
    [("list_of", "，", 3), ("lacks", "、")],
    [("contains_any", "因為"), ("chars", "", 20)],
    [("lines", 4), ("each_line_chars", 4, 4)],
    [("lines", 3), ("each_line_starts", "- ")],
    [("exact", "TAIWAN", "ROC", "TW")],
    [("occurs", "。", 2), ("starts", "夜市")],
    [("ends", *YES_MARKS), ("contains_any", "來"), ("chars", "", 19)],
    [("chars", 30, 80), ("traditional",)],
    [("without_blanks_is", "你好嗎"), ("occurs", " ", 2)],
    [("list_of", "、", 5), ("list_even", "、")],
    [("one_line",), ("chars", 11, ""), ("han",)],
]
_JA = [
    [("list_of", "、", 3)],
    [("exact", "はい")],
    [("occurs", "。", 2), ("ends", "。")],
    [("chars", 6, 50), ("kana",)],
    [("lacks", "コーヒー"), ("chars", 21, "")],
    [("exact", "7")],
    [("lines", 3), ("each_line_chars", "", 8)],
    [("lacks_match", "[、。！？，．]"), ("chars", 6, ""), ("kana",)],
    [("starts", "答えは"), ("contains_any", "12", "十二")],
    [("exact_without_blanks", "1,2,3,4,5")],
    [("json_keys", "city", "country")],
    [("lacks_match", "[0-9０-９]"), ("chars", 21, "")],
    [("list_of", "、", 3), ("occurs_raw", "こんにちは", 3)],
    [("exact", "はい")],
    [("starts", "東京"), ("ends_without", "。", "です")],
    [("ends", *YES_MARKS), ("chars", 6, "")],
    [("contains_any", "なぜなら"), ("chars", "", 20)],
    [("lines", 4), ("each_line_chars", 4, 4)],
    [("lines", 3), ("each_line_starts", "- ")],
    [("exact", "JAPAN")],
    [("occurs", "。", 2), ("starts", "夜市")],
    [("ends", "か。", "か", "？", "?"), ("chars", "", 19)],
    [("chars", 30, 80), ("kana",)],
    [("list_of", "、", 5), ("list_even", "、")],
    [("one_line",), ("chars", 11, ""), ("kana",)],
    [("exact", "ありがとう")],
    [("list_of", "、", 3), ("list_each_matches", "、", "^[ァ-ヴー]+$")],
    [("chars_without", "[、。！？]", 10, 10)],
    [("lacks", "猫"), ("chars", 11, ""), ("kana",)],
    [("occurs", "。", 1), ("ends", "。")],
]
_EN = [
    [("list_of", ",", 3)],
    [("exact", "YES")],
    [("occurs", ".", 2), ("ends", ".")],
    [("words", 4, 30), ("matches", "(?i)learn|data|model|algorithm")],
    [("lacks_lower", "e"), ("length", 41, "")],
    [("json_keys", "city", "country")],
    [("exact", "7")],
    [("lines", 3), ("each_line_words", "", 3)],
    [("lacks_match", "[.,;:!?]"), ("words", 4, "")],
    [("starts", "The answer is"), ("contains_any", "12")],
    [("exact_without_blanks", "1,2,3,4,5")],
    [("lacks_match", r"(?U)\d"), ("words", 16, "")],
    [("list_of", ",", 3), ("occurs_lower", "hello", 3)],
    [("exact_lower", "yes")],
    [("starts", "Taiwan"), ("ends_lower_without", ".!", "island")],
    [("ends", "?"), ("words", 3, "")],
    [("contains_any_lower", "because"), ("words", "", 20)],
    [("lines", 4), ("each_line_words", "", 3)],
    [("lines", 3), ("each_line_starts", "- ")],
    [("exact", "JAPAN")],
    [("occurs", ".", 2), ("starts", "Night markets")],
    [("ends", "?"), ("words", "", 8)],
    [("words", 30, 60)],
    [("list_of", ",", 5), ("list_even", ",")],
    [("one_line",), ("words", 6, "")],
    [("lowercase",), ("words", 5, "")],
    [("words_without", "[.,;:!?]", 10, 10)],
    [("lacks_lower", "dog"), ("words", 6, "")],
    [("occurs", ".", 1), ("ends", "."), ("contains_any_lower", "fuji")],
    [("exact", "ABC")],
]
INSTRUCTIONS = [(i, lang, checks) for i, (lang, checks) in enumerate([*(("zhtw", c) for c in _ZHTW), *(("ja", c) for c in _JA), *(("en", c) for c in _EN)], 1)]

# --- Fixed values: general knowledge ---
FUNCTION = [("contains_any", "def"), ("contains_any", "%"), ("contains_any", "2")]
WATER = [("formula_any", "H2O")]
_G_ZHTW = [
    [("contains_any", "玉山")], [("number_any", "740")], [("contains_any", "六")], [("contains_any", "台北", "臺北")], [("number_any", "100")], [("number_any", "12", "十二")],
    [("contains_any", "濁水溪")], [("contains_any", "葉")], [("number_any", "81")], [("number_any", "365")], [("contains_any", "曹雪芹")], WATER,
    [("contains_any", "新台幣", "新臺幣", "台幣", "臺幣")], [("number_any", "25")], [("number_any", "36", "37")], [("contains_any", "水星")], [("number_any", "1912")], [("number_any", "1000", "一千")],
    [("contains_any", "尼泊爾"), ("contains_any", "中國", "西藏")], [("number_any", "8")], FUNCTION, [("contains_any_lower", "color")], [("contains_any", "O"), ("contains_any", "陰", "O型", "O 型")], [("contains_any", "太平洋")],
    [("number_any", "168")], [("contains_any", "不", "沒")], [("contains_any", "碳")], [("number_any", "60")], [("contains_any", "春節")], [("number_any", "300000", "30萬", "三十萬")],
]
_G_JA = [
    [("contains_any", "東京")], [("number_any", "12", "十二")], [("number_any", "3776")], [("contains_any", "信濃")], [("number_any", "100")], [("number_any", "81")],
    [("number_any", "365")], WATER, [("contains_any", "円", "エン")], [("number_any", "25")], [("contains_any", "水星")], [("number_any", "1000", "千")],
    [("number_any", "8")], FUNCTION, [("contains_any", "紫式部")], [("contains_any", "炭素")], [("number_any", "168")], [("contains_any", "北海道")],
    [("contains_any", "葉")], [("number_any", "60")], [("number_any", "1868")], [("number_any", "36", "37")], [("contains_any", "ない", "よくない", "悪い")], [("contains_any", "ネパール"), ("contains_any", "中国", "チベット")],
    [("contains_any", "桜", "サクラ", "菊")], [("number_any", "300000", "30万", "三十万")], [("number_any", "51")], [("contains_any", "木星")], [("contains_any_lower", "thank")], [("matches", r"(?U)\bO\b")],
]
_G_EN = [
    [("contains_any", "Tokyo")], [("number_any", "51")], FUNCTION, [("contains_any", "Jupiter")], [("number_any", "100")], [("number_any", "81")],
    [("number_any", "365")], WATER, [("number_any", "25")], [("contains_any", "Mercury")], [("number_any", "1000")], [("number_any", "8")],
    [("contains_any", "Shakespeare")], [("contains_any_lower", "carbon")], [("number_any", "168")], [("contains_any_lower", "leaf", "leaves")], [("number_any", "60")], [("number_any", "1945")],
    [("number_any", "36", "37")], [("contains_any_lower", "weather"), ("matches", r"(?i)\bnot\b|n't")], [("contains_any", "Nepal"), ("contains_any", "China", "Tibet")], [("number_any", "300000", "299792")], [("matches", r"(?U)\bO\b")], [("contains_any", "Shinano")],
    [("number_any", "77")], [("matches", r"(?i)[6６]|six")], [("matches", r"(?i)carbon dioxide|co[2₂]")], [("matches", r"(?i)h[ -]*y[ -]*p[ -]*e[ -]*r[ -]*t[ -]*e[ -]*x[ -]*t")], [("digits_start", "1259")], [("contains_any", "Pacific")],
]
GENERAL = [(i, lang, checks) for i, (lang, checks) in enumerate([*(("zhtw", c) for c in _G_ZHTW), *(("ja", c) for c in _G_JA), *(("en", c) for c in _G_EN)], 1)]
