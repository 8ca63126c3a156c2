"""Languages of documents and of stretches within them, by averaged hashed subword embeddings.

A sentence is the mean of the embeddings of its words' subwords (character n-grams and the whole
word, hashed into BUCKETS rows); a linear softmax over that mean gives the languages. The model
is trained by stochastic gradient descent in numpy on sentences of a bounded, hash-ordered
sample of labelled documents (DOCS_EACH for each language, SENTENCES_EACH from each document,
evenly over the document; both are parameters of ``train``). A sampled sentence is taken whole.
Labels are partly wrong, so models of two halves of the documents judge each other's half first,
and the sentences whose label has less than half the probability of the best language are left
out of the final fit. On held-out
sentences a temperature makes the probabilities honest, and the rejection threshold is the
lowest at which accepted sentences are right in ACCEPT of all cases.

As everything before the softmax is a sum over words, each distinct word is embedded and
projected once for a worker; a sentence costs one look-up for each word. Whole texts are read,
and nothing depends on the length of a text, a line, a quotation or a word.

What counts as a sentence: text up to a terminator that a space or the end follows, of at least
MIN_WORDS words after genes, identifiers, numbers, code in back-quotes and quoted terms are left
out (MIN_SIGNS characters in scripts without spaces). Headings, table rows, list entries and
whatever else ends without a terminator are none. A quotation lies within a line; it is a term and
left out unless it holds a whole sentence (a terminator at its end or before a space, and more than
three spaces). A word of any length counts by its subwords.

Defined cases: null, empty and blank texts and texts without sentences have no language (null,
confidence null) and are no case; repeated texts are judged each; an empty table gives no rows;
without any labelled document every language is null; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm.bpe import slices
from genoloom.runtime import pick

BUCKETS, WIDTH, EPOCHS, LEAST_STEPS, RATE, BATCH, SEED = 1 << 17, 12, 3, 200, 0.2, 128, 5
DOCS_EACH, SENTENCES_EACH = 400, 6
MIN_WORDS, MIN_SIGNS = 3, 6
ACCEPT = 0.995
#: A worker's table of words is begun anew beyond this many words or letters; results don't depend on it.
KNOWN, KNOWN_LETTERS = 300_000, 1 << 24

_SIGNS = r"぀-ヿ㐀-鿿豈-﫿"
#: A sign of a script without spaces, or a run of other word characters (joined by :: - or apostrophes).
WORD = re.compile(rf"[{_SIGNS}]|[^\W{_SIGNS}]+(?:(?:::|[-'’])[^\W{_SIGNS}]+)*")
_BREAK = re.compile(rf"[.!?…]+[\"'”’)\]]*(?=\s|$|[{_SIGNS}])|[。！？]+[」』”]*|\n")
_FENCE = re.compile(r"```.*?```|`[^`\n]*`", re.S)
#: A straight quote opens where no letter or digit of a script with spaces stands before it (5" is no quotation).
_LETTER = "0-9A-Za-z\u00c0-\u052f"
_QUOTE = re.compile(rf"(?<![{_LETTER}])\"[^\"\n]*\"(?![{_LETTER}])|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」")
_WITHIN = re.compile(r"[.!?…](?=\s)|[。！？]")
_MARKS = frozenset("#-*|>@`+=\n")


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def _quoted(m: re.Match) -> str:
    inner = m.group()[1:-1].rstrip() + " "
    return m.group() if inner.count(" ") > 4 and _WITHIN.search(inner) else " " * len(m.group())


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(from, to, words) of the candidate sentences; positions are those of the text."""
    if "`" in text:
        text = _FENCE.sub(_blank, text)
    if '"' in text or not text.isascii():
        text = _QUOTE.sub(_quoted, text)
    out, at, n = [], 0, len(text)
    for m in _BREAK.finditer(text):
        start, end = m.span()
        if text[start] != "\n":
            out.append((at, end, text[at:start]))
            at = end
            continue
        # a line end closes what stands open only at headings, before marks and blank lines
        piece = text[at:start].lstrip()
        if not piece or piece[0] == "#" or end == n or text[end] in _MARKS:
            at = end
    return out


def _subwords(word: str) -> np.ndarray:
    w = f"<{word}>"
    grams = {w}
    for k in (3, 4, 5):
        grams.update(w[i : i + k] for i in range(len(w) - k + 1))
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in sorted(grams)], np.int64)


def _natural(token: str) -> bool:
    """Whether a token can be a word: no identifier, gene or number."""
    return not ("_" in token or "::" in token or any(c.isdigit() for c in token))


class Words(dict):
    """Token -> row of the table of (projected sums, number of subwords, words, signs)."""

    def __init__(self, projected: np.ndarray | None = None):
        super().__init__()
        self.projected = projected
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.letters = 0
        self.subs: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.table = None

    def __missing__(self, token: str) -> int:
        word = token.lower()
        sign = len(token) == 1 and ord(token) >= 0x3040
        subs = _subwords(word) if _natural(word) else np.zeros(0, np.int64)
        if self.projected is None:
            self.subs.append(subs)
        else:
            sums = self.projected[subs].sum(0) if len(subs) else np.zeros(self.projected.shape[1])
            self.rows.append(np.r_[sums, len(subs), len(subs) > 0 and not sign, len(subs) > 0 and sign])
        self[token] = number = len(self)
        self.letters += len(token)
        return number

    def sums(self, tokens: np.ndarray) -> np.ndarray:
        if self.table is None or len(self.table) < len(self.rows):
            fresh = np.array(self.rows[0 if self.table is None else len(self.table) :])
            self.table = fresh if self.table is None else np.concatenate([self.table, fresh])
        return self.table[tokens]


def enough(words, signs):
    return (words >= MIN_WORDS) | (signs >= MIN_SIGNS)


class Model:
    """Embeddings times weights, the bias, the temperature and the rejection threshold."""

    def __init__(self, langs: list[str], projected: np.ndarray, bias: np.ndarray, heat: float = 1.0, reject: float = 0.5):
        self.key = uuid.uuid4().hex  # tells workers which model their table of words belongs to
        self.langs, self.projected, self.bias, self.heat, self.reject = langs, projected.astype(np.float32), bias, heat, reject

    def probabilities(self, sums: np.ndarray, subwords: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(subwords, 1)[:, None] + self.bias) / self.heat
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _sgd(bags: list[np.ndarray], labels: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    used, flat = np.unique(np.concatenate(bags), return_inverse=True)  # only rows that occur are trained
    sizes = np.fromiter(map(len, bags), np.int64, len(bags))
    starts = np.cumsum(sizes) - sizes
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (len(used), WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, classes)).astype(np.float32), np.zeros(classes, np.float32)
    batches = -(-len(bags) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    # steps scaled by the root of the squared gradients so far keep common subwords from overshooting
    seen_emb, seen_out, seen_bias = np.full_like(emb, 1e-10), np.full_like(out, 1e-10), np.full_like(bias, 1e-10)
    grad = np.zeros_like(emb)
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for lo in range(0, len(bags), BATCH):
            pick_ = order[lo : lo + BATCH]
            n = sizes[pick_]
            ends = np.cumsum(n)
            rows = flat[np.arange(ends[-1]) - np.repeat(ends - n - starts[pick_], n)]
            mean = np.add.reduceat(emb[rows], ends - n, axis=0) / n[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick_)), labels[pick_]] -= 1
            p /= len(pick_)
            grad[:] = 0
            np.add.at(grad, rows, np.repeat((p @ out.T) / n[:, None], n, axis=0).astype(np.float32))
            for value, g, seen in ((emb, grad, seen_emb), (out, mean.T @ p, seen_out), (bias, p.sum(0), seen_bias)):
                seen += g * g
                value -= rate * g / np.sqrt(seen)
    table = np.zeros((BUCKETS, WIDTH), np.float32)
    table[used] = emb
    return table, out, bias


def fit(rows: list[tuple[str, int, str]]) -> Model | None:
    """Train on (language, document, sentence); every fifth document is held out."""
    rows = [r for r in rows if r[2]]
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    words, bags, label, doc = Words(), [], [], []
    for lang, d, text in rows:
        tokens = [words[t] for t in WORD.findall(text)]
        got = [words.subs[t] for t in tokens if len(words.subs[t])]
        if len(got) >= MIN_WORDS:
            bags.append(np.concatenate(got))
            label.append(langs.index(lang))
            doc.append(d)
    if not bags:
        return None
    label, doc = np.array(label), np.array(doc)
    held = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d in doc])
    if held.all() or not held.any():
        held = np.zeros(len(doc), bool)
    fold = np.array([zlib.crc32(f"{d}|fold".encode()) % 2 for d in doc])

    def trained(use: np.ndarray):
        table, out, bias = _sgd([b for b, u in zip(bags, use) if u], label[use], len(langs))
        z = np.array([table[b].mean(0) for b in bags]) @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        return (table, out, bias), z, p / p.sum(1, keepdims=True)

    # Each half of the documents is judged by a model of the other half, which can't have learnt its
    # wrong labels by heart. A common language gets into the sentences of every label, and its own
    # probability falls with that; what counts is how far the label stands behind the best language.
    wrong = np.zeros(len(doc), bool)
    for half in (0, 1):
        if len(np.unique(label[fold != half])) == len(langs):
            _, _, p = trained(fold != half)
            wrong |= (fold == half) & (p.max(1) > 2 * p[np.arange(len(p)), label])
    keep = ~held & ~wrong
    if len(np.unique(label[keep])) < len(langs):
        keep = ~held
    (table, out, bias), z, _ = trained(keep)
    test = held & ~wrong
    if not test.any():
        test = ~wrong if not wrong.all() else np.ones(len(doc), bool)
    heats = np.geomspace(0.5, 4, 30)

    def loss(h):
        s = z[test] / h
        s -= s.max(1, keepdims=True)
        return -(s[np.arange(len(s)), label[test]] - np.log(np.exp(s).sum(1))).mean()

    heat = float(min(heats, key=loss))
    s = z[test] / heat
    q = np.exp(s - s.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    top, good = q.max(1), q.argmax(1) == label[test]
    order = np.argsort(-top)
    right = np.cumsum(good[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(right >= ACCEPT)
    reject = float(np.clip(top[order][fine[-1]] if len(fine) else 0.9, 0.5, 0.95))
    return Model(langs, table @ out, bias, heat, reject)


def labelled(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """doc_id, text, lang: the label as a two-letter code, null where it is missing."""
    names = pick(tags, ["lang_tag", "lang"]).where("lang_tag is not null").groupBy("lang_tag").agg(F.min("lang").alias("code"))
    docs = pick(documents, ["doc_id", "text", "lang"])
    return docs.join(names, docs["lang"] == names["lang_tag"], "left").select("doc_id", "text", F.col("code").alias("lang"))


def training_rows(docs: DataFrame, docs_each: int = DOCS_EACH, sentences_each: int = SENTENCES_EACH) -> list[tuple[str, int, str]]:
    """At most ``sentences_each`` sentences of at most ``docs_each`` documents for each language."""
    order = F.xxhash64("doc_id", F.lit(SEED))
    known = docs.where("lang is not null and text is not null and length(text) > 20")
    chosen = known.select("doc_id", "lang").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")))
    chosen = chosen.where(F.col("k") <= docs_each).select("doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, t, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                found = [s.strip() for _, _, s in sentences(t)]
                found = [s for s in found if len(s) > 15]
                step = max(1, len(found) // sentences_each)
                out += [(lang, d, s) for s in found[::step][:sentences_each]]
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c)], ["lang", "doc_id", "sentence"])

    picked = docs.join(F.broadcast(chosen), "doc_id").mapInArrow  # bounded: docs_each for each language
    return sorted(tuple(r) for r in picked(cut, "lang string, doc_id long, sentence string").collect())


def train(documents: DataFrame, tags: DataFrame, docs_each: int = DOCS_EACH, sentences_each: int = SENTENCES_EACH) -> Model | None:
    return fit(training_rows(labelled(documents, tags), docs_each, sentences_each))


def judge(own: Words, model: Model, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(text number, (from, to), language number or -1, confidence) of all sentences of the texts."""
    if len(own) > KNOWN or own.letters > KNOWN_LETTERS:
        own.forget()
    numbers, counts, spans, which = [], [], [], []
    get = own.__getitem__
    for i, text in enumerate(texts):
        if not text:
            continue
        for a, b, piece in sentences(text):
            tokens = WORD.findall(piece)
            if len(tokens) >= MIN_WORDS:
                numbers.extend(map(get, tokens))
                counts.append(len(tokens))
                spans.append((a, b))
                which.append(i)
    if not counts:
        return np.zeros(0, int), [], np.zeros(0, int), np.zeros(0)
    n = np.array(counts)
    sums = np.add.reduceat(own.sums(np.array(numbers)), np.cumsum(n) - n, axis=0)
    k = len(model.langs)
    p = model.probabilities(sums[:, :k], sums[:, k])
    whole = enough(sums[:, k + 1], sums[:, k + 2])
    best = p.argmax(1)
    return np.array(which), spans, np.where(whole, np.where(p.max(1) >= model.reject, best, -1), -2), p.max(1)


_words: dict[str, Words] = {}


def segments(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, label, segments(from, to, lang, n_sentences, confidence) of (doc_id, text, lang) rows.

    Neighbouring sentences of one language are one segment; from and to count characters.
    """
    schema = "doc_id long, label string, segments array<struct<start:int,end:int,lang:string,n_sentences:int,confidence:double>>"
    docs = docs.select("doc_id", "text", "lang")
    if model is None:
        none = F.from_json(F.lit("[]"), schema.split("segments ")[1])
        return docs.select("doc_id", F.col("lang").alias("label"), none.alias("segments"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("n_sentences", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m.key not in _words:
            _words.clear()
            _words[m.key] = Words(m.projected)
        own = _words[m.key]
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                which, spans, lang, sure = judge(own, m, texts)
                rows: list[list] = [[] for _ in texts]
                for i, (a, b), l, c in zip(which, spans, lang, sure):
                    if l < 0:
                        continue
                    name, row = m.langs[l], rows[i]
                    if row and row[-1]["lang"] == name:
                        last = row[-1]
                        last["end"], last["n_sentences"], last["confidence"] = b, last["n_sentences"] + 1, last["confidence"] + c
                    else:
                        row.append({"start": a, "end": b, "lang": name, "n_sentences": 1, "confidence": float(c)})
                for row in rows:
                    for s in row:
                        s["confidence"] = round(s["confidence"] / s["n_sentences"], 4)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(rows, kind)], ["doc_id", "label", "segments"])

    return docs.mapInArrow(run, schema)


def document_languages(documents: DataFrame, tags: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, label (code or null), langs (distinct, sorted), lang, confidence, segments of every document.

    lang is the language of the most sentences; its confidence is the mean over its sentences.
    """
    model = model or train(documents, tags)
    found = segments(labelled(documents, tags), model)
    names = F.array_sort(F.array_distinct(F.col("segments.lang")))
    tally = F.transform(
        "langs",
        lambda x: F.struct(
            F.aggregate(F.filter("segments", lambda s: s["lang"] == x), F.lit(0), lambda a, s: a + s["n_sentences"]).alias("n"),
            F.aggregate(F.filter("segments", lambda s: s["lang"] == x), F.lit(0.0), lambda a, s: a + s["n_sentences"] * s["confidence"]).alias("c"),
            x.alias("lang"),
        ),
    )
    found = found.withColumn("langs", names).withColumn("best", F.array_max(tally))
    return found.select(
        "doc_id", "label", "langs", F.col("best.lang").alias("lang"), F.round(F.col("best.c") / F.col("best.n"), 4).alias("confidence"), "segments"
    )


def label_cases(languages: DataFrame) -> DataFrame:
    """doc_id, lang: the languages of documents with a missing or wrong label or with several languages."""
    case = F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)
    return languages.where((F.size("langs") > 0) & case).select("doc_id", F.explode("langs").alias("lang"))
