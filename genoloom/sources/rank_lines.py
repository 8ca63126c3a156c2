"""Ranking files as delivered: valid rows on one side, failing lines with one reason on the other.

A line is split once by JVM expressions. Genes and scores repeat massively, so each distinct
value of a column is judged once; only the invalid ones enter a dictionary (column, value,
reason) that is joined back. The structural checks need no dictionary.

Defined cases: null and blank lines, comment lines and header lines yield no row at all; an
empty table yields empty results; other columns of the input are ignored, whatever their names;
repeated lines are judged each; a line of any length is one value (the patterns are possessive,
so they neither backtrack nor recurse).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.runtime import SPACES, materialize, pick

#: Fixed by the task: spellings that stand for a missing gene.
MISSING = ("na", "n/a", "nan", "null", "none")
SCORE = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

_WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "]"
_FIELD = rf'(?:{_WS}*+"[^"]*+(?:""[^"]*+)*+"{_WS}*+|[^",]*+)'
_TWO = rf"\A({_FIELD}),({_FIELD})\z"


def _value(raw: Column) -> Column:
    """A field without blanks around it, unquoted, its doubled quotes single."""
    inner = F.regexp_replace(F.trim(raw, F.lit(SPACES)), r'(?s)\A"(.*)"\z', "$1")
    return F.trim(F.replace(inner, F.lit('""'), F.lit('"')), F.lit(SPACES))


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that later predicates can't be pushed below, so that nothing is computed twice."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("file_id", "line_no", F.inline(F.array(row)))


def split_lines(lines: DataFrame) -> DataFrame:
    """file_id, line_no, quoting_ok, two_fields, gene, score of every line that is data."""
    line = F.col("raw_line")
    body = F.trim(F.regexp_replace(line, r"\A\x{feff}", ""), F.lit(SPACES))
    df = _computed(pick(lines, ["file_id", "line_no", "raw_line"]), body=body)
    df = df.where(F.col("body").isNotNull() & (F.col("body") != "") & ~F.col("body").startswith("#"))
    plain = ~F.col("body").contains('"')
    parts = F.split("body", ",", -1)
    df = _computed(
        df,
        quoting_ok=plain | F.col("body").rlike(rf"\A{_FIELD}(?:,{_FIELD})*+\z"),
        two_fields=F.when(plain, F.size(parts) == 2).otherwise(F.col("body").rlike(_TWO)),
        g=F.when(plain, F.get(parts, F.lit(0))).otherwise(F.regexp_extract("body", _TWO, 1)),
        s=F.when(plain, F.get(parts, F.lit(1))).otherwise(F.regexp_extract("body", _TWO, 2)),
    )
    two = F.col("two_fields")
    df = _computed(
        df,
        quoting_ok=F.col("quoting_ok"),
        two_fields=two,
        gene=F.when(two, _value(F.col("g"))),
        score=F.when(two, _value(F.col("s"))),
    )
    header = F.col("two_fields") & (F.lower("gene") == "gene") & (F.lower("score") == "score")
    return df.where(~F.coalesce(header, F.lit(False)))


def judged_values(parsed: DataFrame) -> DataFrame:
    """kind, value, number, reason of every distinct value of a column: each is judged and cast once."""
    whole = parsed.where("quoting_ok and two_fields")
    distinct = (
        whole.select(F.lit("gene").alias("kind"), F.col("gene").alias("value"))
        .union(whole.select(F.lit("score"), F.col("score")))
        .distinct()
    )
    value = F.col("value")
    bad_gene = ~value.rlike("[A-Za-z]") | F.lower(value).isin(*MISSING)
    number = F.when((F.col("kind") == "score") & value.rlike(SCORE), value.try_cast("double"))
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return distinct.select("kind", "value", number.alias("number")).select(
        "*", F.when(F.when(F.col("kind") == "gene", bad_gene).otherwise(F.col("number").isNull()), F.col("kind")).alias("reason")
    )


def invalid_values(values: DataFrame) -> DataFrame:
    """The dictionary: every distinct value that its column can't hold, with the reason."""
    return values.where("reason is not null").select("kind", "value", "reason")


def _with_reason(parsed: DataFrame, bad: DataFrame) -> DataFrame:
    genes = bad.where("kind = 'gene'").select(F.col("value").alias("gene"), F.col("reason").alias("bad_gene"))
    scores = bad.where("kind = 'score'").select(F.col("value").alias("score"), F.col("reason").alias("bad_score"))
    # broken lines carry no values, so only whole ones meet the dictionary
    return (
        parsed.join(genes, "gene", "left")
        .join(scores, "score", "left")
        .withColumn(
            "reason",
            F.when(~F.col("quoting_ok"), "quoting")
            .when(~F.col("two_fields"), "column_count")
            .otherwise(F.coalesce("bad_gene", "bad_score")),
        )
    )


def failing_lines(lines: DataFrame) -> DataFrame:
    """file_id, line_no, reason of the lines that fail."""
    parsed = materialize(split_lines(lines))  # lines are split once
    bad = materialize(invalid_values(judged_values(parsed)))
    return _with_reason(parsed, bad).where("reason is not null").select("file_id", "line_no", "reason")


def valid_rows(lines: DataFrame) -> DataFrame:
    """file_id, line_no, gene, score of the lines that hold a valid pair."""
    parsed = materialize(split_lines(lines))
    values = materialize(judged_values(parsed))
    good = _with_reason(parsed, invalid_values(values)).where("reason is null").select("file_id", "line_no", "gene", "score")
    numbers = values.where("kind = 'score' and reason is null").select(F.col("value").alias("score"), "number")
    return good.join(numbers, "score").select("file_id", "line_no", "gene", F.col("number").alias("score"))


#: The same rules for DuckDB (RE2 has no possessive quantifiers; none are needed there).
_BODY = "trim(case when raw_line[1] = chr(65279) then raw_line[2:] else raw_line end, '{ws}')"


def _sql_spaces() -> str:
    return "' || " + " || ".join(f"chr({ord(c)})" for c in SPACES) + " || '"


def judged_sql() -> str:
    ws = "".join(f"\\x{{{ord(c):x}}}" for c in SPACES)
    field = rf'(?:[{ws}]*"(?:[^"]|"")*"[{ws}]*|[^",]*)'
    body = _BODY.format(ws=_sql_spaces())
    trim = lambda x: f"trim({x}, '{_sql_spaces()}')"
    value = lambda x: f"""case when length({trim(x)}) >= 2 and {trim(x)}[1] = '"' and {trim(x)}[-1] = '"' then {trim(f"replace({trim(x)}[2:-2], '\"\"', '\"')")} else {trim(x)} end"""
    missing = ", ".join(f"'{m}'" for m in MISSING)
    return f"""
    with b as (select file_id, line_no, {body} as body from ranked_genes_for_gsea_raw),
    d as (select *, regexp_matches(body, '^{field}(?:,{field})*$', 's') as quoting_ok,
            regexp_matches(body, '^{field},{field}$', 's') as two_fields,
            regexp_extract(body, '^({field}),({field})$', 1, 's') as g,
            regexp_extract(body, '^({field}),({field})$', 2, 's') as s
          from b where body is not null and body <> '' and body[1] <> '#'),
    v as (select file_id, line_no, quoting_ok, two_fields, {value('g')} as gene, {value('s')} as score from d),
    j as (select *, case when not quoting_ok then 'quoting' when not two_fields then 'column_count'
            when not regexp_matches(gene, '[A-Za-z]') or lower(gene) in ({missing}) then 'gene'
            when not regexp_matches(score, '{SCORE}') or not coalesce(isfinite(try_cast(score as double)), false) then 'score' end as reason
          from v where not (two_fields and lower(gene) = 'gene' and lower(score) = 'score'))
    """
