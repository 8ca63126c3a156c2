import csv
import io
import random
import re

from genoloom.sources import rank_lines

BLANK = " \t\r\n\x0b\x0c\x1c\x85\xa0   　"
MISSING = {"na", "n/a", "nan", "null", "none"}


def judge(line):
    """A scanner written apart from the operator: None (skipped), a reason, or (gene, score)."""
    if line is None:
        return None
    text = line.removeprefix("﻿").strip(BLANK)
    if not text or text.startswith("#"):
        return None
    fields, i, n = [], 0, len(text)
    while True:
        while i < n and text[i] in BLANK:
            i += 1
        if i < n and text[i] == '"':
            out, i = [], i + 1
            while True:
                if i >= n:
                    return "quoting"
                if text[i] == '"':
                    if text[i + 1 : i + 2] == '"':
                        out.append('"')
                        i += 2
                        continue
                    i += 1
                    break
                out.append(text[i])
                i += 1
            while i < n and text[i] in BLANK:
                i += 1
            if i < n and text[i] != ",":
                return "quoting"
            fields.append("".join(out).strip(BLANK))
        else:
            j = text.find(",", i)
            j = n if j < 0 else j
            if '"' in text[i:j]:
                return "quoting"
            fields.append(text[i:j].strip(BLANK))
            i = j
        if i >= n:
            break
        i += 1
    if len(fields) == 2 and [x.lower() for x in fields] == ["gene", "score"]:
        return None
    if len(fields) != 2:
        return "column_count"
    gene, score = fields
    if not re.search("[A-Za-z]", gene) or gene.lower() in MISSING:
        return "gene"
    if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", score) or abs(float(score)) == float("inf"):
        return "score"
    return gene, float(score)


FIXED = [
    None, "", "  \t", "\r\n", "#x,1", " # x", "gene,score", '﻿"Gene", SCORE \r', "A,1", ' "A" , "1" ', '"A,b",2', '"A ""b""",2', '"A,2', 'A",2', '"A"x,2', "A", "A,1,2", "A,,1", ",1", "NA,1",
    '" N/A ",1', "none,x", "A,", "A,1e", "A,.", "A,.5", "A,5.", "A,+1e-3", "A,1e999", "A,-1e400", "A,0x1F", "A,１.５", "A,1_0", "A,inf", "A,NaN", "123,4", "β,4", "βa,4", '"",""', "A;1", "A\t1",
    '"A","1","2"', "A,1,", '"A\nB",1', "A" * 200_000 + ",1", '"' + "x" * 200_000 + '",1', '"' + 'a""' * 50_000 + '",1', '"' * 100_001 + ",1",
]


def run(spark, lines):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "file_id long, line_no long, raw_line string").selectExpr("*", "'c' as gene", "'d' as reason", "1 as body")
    bad = {r.line_no: r.reason for r in rank_lines.failing_lines(df).collect()}
    good = {r.line_no: (r.gene, r.score) for r in rank_lines.valid_rows(df).collect()}
    assert not set(bad) & set(good)
    return {**bad, **good}


def test_fixed_lines(spark):
    want = {i: w for i, x in enumerate(FIXED) if (w := judge(x)) is not None}
    assert run(spark, FIXED) == want


def test_random_lines(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choice(['"', '"', ",", "A", "1", " ", ".", "-", "e", "\t", "NA"]) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    assert run(spark, lines) == {i: w for i, x in enumerate(lines) if (w := judge(x)) is not None}


def test_written_by_a_csv_writer(spark):
    rng, rows, buffer = random.Random(3), [], []
    for _ in range(200):
        gene = "G" + "".join(rng.choice('ab",x ') for _ in range(5)) + "g"
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow([gene, "1.5"])
        buffer.append(out.getvalue())
        rows.append((gene, 1.5))
    assert run(spark, buffer) == dict(enumerate(rows))


def test_empty(spark):
    df = spark.createDataFrame([], "file_id long, line_no long, raw_line string")
    assert rank_lines.failing_lines(df).count() == 0 and rank_lines.valid_rows(df).count() == 0
