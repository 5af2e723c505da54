"""Rule graders: a table of rules, one expression for each kind of check, a rule passes if all its checks do.

Rules are rows (rule_id, lang, checks) with checks an array of (kind, args array<string>); answers are joined to them.
A check that cannot be evaluated fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import constants as K
from siftwright.functions import text as T

CHECKS = "array<struct<kind:string,args:array<string>>>"


def _lines(t: Column) -> Column:
    return F.filter(F.transform(F.split(T.strip(t), "\n"), T.strip), lambda x: x != "")


def _chars(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"(?U)\s", ""))


def _words(t: Column) -> Column:
    return F.filter(F.split(T.strip(t), r"(?U)\s+"), lambda w: w != "")


def _occurrences(t: Column, mark: Column) -> Column:
    return ((F.length(t) - F.length(F.replace(t, mark, F.lit("")))) / F.greatest(F.length(mark), F.lit(1))).cast("int")


def _between(value: Column, args: Column) -> Column:
    """args[0] <= value <= args[1]; an empty bound is none."""
    low, high = F.get(args, F.lit(0)).try_cast("int"), F.get(args, F.lit(1)).try_cast("int")
    return F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))


def _without(t: Column, marks: Column) -> Column:
    """Without any of the marks at the end."""
    return F.regexp_replace(t, F.concat(F.lit("["), marks, F.lit("]+$")), F.lit(""))


def check(kind: Column, args: Column, answer: Column, simplified: str | None = None) -> Column:
    """Whether an answer passes one check. Without a set of simplified characters no text counts as traditional."""
    t = T.strip(answer)
    arg = lambda i: F.get(args, F.lit(i))
    rest = lambda n: F.slice(args, F.lit(n + 1), F.greatest(F.size(args) - n, F.lit(0)))
    stop, marks = _without(t, F.lit("。.")), _without(t, F.lit("。.！!"))
    parts = F.filter(F.split(stop, F.concat(F.lit("\\Q"), arg(0), F.lit("\\E"))), lambda x: T.strip(x) != "")
    only = ~stop.rlike("[：:！!。]") & ~stop.contains("\n") & (F.length(stop) < 40)
    every = F.split(stop, F.concat(F.lit("\\Q"), arg(0), F.lit("\\E")))
    number = T.numeric_form(answer)
    keys = F.map_keys(F.from_json(t, "map<string,string>"))
    any_of = lambda test: F.exists(args, test)
    tests: dict[str, Column] = {
        "exact": F.array_contains(args, marks),
        "exact_lower": F.array_contains(args, F.lower(marks)),
        "exact_without_blanks": F.array_contains(args, _without(F.replace(t, F.lit(" "), F.lit("")), F.lit("。.！!"))),
        "list_of": only & (F.size(parts) == arg(1).try_cast("int")),
        "list_even": F.forall(every, lambda x: T.strip(x).rlike("^[0-9]*[02468]$")),
        "list_each_matches": F.forall(every, lambda x: F.regexp(T.strip(x), arg(1))),
        "lines": F.size(_lines(answer)) == arg(0).try_cast("int"),
        "each_line_chars": F.forall(_lines(answer), lambda x: _between(_chars(x), args)),
        "each_line_words": F.forall(_lines(answer), lambda x: _between(F.size(_words(x)), args)),
        "each_line_starts": F.forall(_lines(answer), lambda x: x.startswith(arg(0))),
        "one_line": ~t.contains("\n"),
        "chars": _between(_chars(answer), args),
        "chars_without": _between(_chars(F.regexp_replace(answer, arg(0), F.lit(""))), rest(1)),
        "length": _between(F.length(t), args),
        "words": _between(F.size(_words(answer)), args),
        "words_without": _between(F.size(_words(F.regexp_replace(answer, arg(0), F.lit("")))), rest(1)),
        "occurs": _occurrences(t, arg(0)) == arg(1).try_cast("int"),
        "occurs_raw": _occurrences(answer, arg(0)) == arg(1).try_cast("int"),
        "occurs_lower": _occurrences(F.lower(t), arg(0)) == arg(1).try_cast("int"),
        "starts": any_of(lambda x: t.startswith(x)),
        "ends": any_of(lambda x: t.endswith(x)),
        "ends_without": F.exists(rest(1), lambda x: _without(t, arg(0)).endswith(x)),
        "ends_lower_without": F.exists(rest(1), lambda x: F.lower(_without(t, arg(0))).endswith(x)),
        "contains_any": any_of(lambda x: answer.contains(x)),
        "contains_any_lower": any_of(lambda x: F.lower(answer).contains(x)),
        "number_any": any_of(lambda x: number.contains(x)),
        "formula_any": any_of(lambda x: F.replace(F.upper(answer), F.lit("₂"), F.lit("2")).contains(x)),
        "digits_start": F.regexp_replace(number, "[^0-9]", "").startswith(arg(0)),
        "lacks": ~any_of(lambda x: answer.contains(x)),
        "lacks_lower": ~any_of(lambda x: F.lower(answer).contains(x)),
        "matches": F.regexp(answer, arg(0)),
        "lacks_match": ~F.regexp(answer, arg(0)),
        "without_blanks_is": F.replace(t, F.lit(" "), F.lit("")) == arg(0),
        "json_keys": (F.size(F.array_except(args, keys)) == 0) & keys.isNotNull(),
        "kana": answer.rlike(f"[{K.KANA}]"),
        "han": answer.rlike(f"[{K.HAN_BASIC}]"),
        "lowercase": t == F.lower(t),
        "traditional": ~answer.rlike(f"[{simplified}]") if simplified else F.lit(False),
    }
    result = F.lit(None).cast("boolean")
    for name, test in tests.items():
        result = F.when(kind == name, test).otherwise(result)
    return F.coalesce(result, F.lit(False))


def grade(answers: DataFrame, rules: DataFrame, answer: str = "output", simplified: str | None = None) -> DataFrame:
    """answers (rule_id, output) with lang and `passed`. Rules are a table of hundreds of rows at most."""
    checks = F.forall("checks", lambda c: check(c["kind"], c["args"], F.coalesce(F.col(answer), F.lit("")), simplified))
    return answers.join(rules.select("rule_id", "lang", F.col("checks").cast(CHECKS).alias("checks")), "rule_id").withColumn("passed", checks & (F.size("checks") > 0)).drop("checks")


def rules_table(spark, rules: list[tuple]) -> DataFrame:
    """Rules from (rule_id, lang, [(kind, *args), ...])."""
    rows = [(i, lang, [(kind, [str(a) for a in args]) for kind, *args in checks]) for i, lang, checks in rules]
    return spark.createDataFrame(rows, f"rule_id long, lang string, checks {CHECKS}")
