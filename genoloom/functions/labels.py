"""Text functions over reference labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these word lists and prefixes.
PREFIXES = ("GOBP", "GOCC", "GOMF", "WP", "KEGG", "REACTOME", "HALLMARK")
STOP_WORDS = (
    "PATHWAY", "PATHWAYS", "PROCESS", "PROCESSES", "SET", "MODULE", "MODULES", "SIGNATURE", "SIGNATURES", "HOMO", "SAPIENS", "MUS", "MUSCULUS",
)
ANCHOR_WORDS = ("ALZHEIMER", "AMYLOID", "TAU", "DEPRESS", "GLUCOCORTICOID", "NEUROINFLAMMATORY")
HIGH_WORDS = (
    "MICROGL", "COMPLEMENT", "INFLAM", "INTERFERON", "CYTOKINE", "IMMUNE", "DEFENSE RESPONSE", "PHAGOCYT", "ENDOLYSOSOM", "LYSOSOM", "SYNAPT", "NEURON",
    "NEUROGEN", "NEUROTRANSMITTER", "ASTROCY", "OLIGOD", "GLIAL", "AXON", "DENDRITE", "MYELIN", "STRESS", "TNFA", "NFKB", "JAK", "CHEMOKINE",
)
MEDIUM_WORDS = ("OXIDATIVE PHOSPHORYLATION", "MITOCHONDRIAL ELECTRON TRANSPORT", "CELL CELL SIGNALING", "TRANSPORT", "LIPID", "CHOLESTEROL")
LOW_WORDS = (
    "FASTK FAMILY", "TRNA PROCESSING", "RRNA PROCESSING", "MRNA MODIFICATION", "RNA DEGRADATION", "TRANSLATION", "PEPTIDE CHAIN", "RIBOSOME", "SPLICING",
    "HTTP BIOREGISTRY", "PATHBANK", "HUMANCYC", "NON STOP MRNA", "VIRAL MRNA",
)
SOURCE_NAMES = {
    "WP": "WikiPathways", "REACTOME": "Reactome", "PATHWAYCOMMONS": "Pathway Commons", "GO_BP": "GO BP", "GO_CC": "GO CC", "GO_MF": "GO MF",
    "HALLMARK": "Hallmark", "KEGG": "KEGG", "CUSTOM": "Custom GMT", "OTHER": "Other",
}


def after_source(name: Column) -> Column:
    """What follows the first ``::``, or the whole label."""
    return F.when(name.contains("::"), F.regexp_replace(name, r"(?s)\A.*?::", "")).otherwise(name)


def source_of(name: Column) -> Column:
    """What precedes ``::``, else a known prefix, else OTHER."""
    out = F.when(name.contains("::"), F.regexp_extract(name, r"(?s)\A(.*?)::", 1))
    for prefix in ("WP", "KEGG", "HALLMARK", "REACTOME"):
        out = out.when(name.startswith(prefix + "_"), prefix)
    return out.otherwise("OTHER")


def source_display(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(known, source), F.replace(source, F.lit("_"), F.lit(" ")))


def _bare(name: Column, prefixes: tuple[str, ...]) -> Column:
    return F.regexp_replace(after_source(name), rf"(?i)\A(?:{'|'.join(prefixes)})_+", "")


def program_label(name: Column, longest: int = 60) -> Column:
    """A compact label: letters, digits and single underscores, known prefixes set apart."""
    safe = F.regexp_replace(after_source(name), r"[ \-./:_]+", "_")
    safe = F.regexp_replace(safe, r"[^\p{L}\p{N}_]", "")
    safe = F.regexp_replace(F.regexp_replace(safe, "_{2,}", "_"), r"\A_+|_+\z", "")
    for prefix in ("GOBP", "KEGG", "HALLMARK"):
        safe = F.regexp_replace(safe, rf"\A{prefix}(?!_)", prefix + "_")
    return F.substring(F.when(safe == "", "Annotated").otherwise(safe), 1, longest)


def family_key(name: Column) -> Column:
    """Words of the label without prefixes and stop words; all words when nothing else is left."""
    words = F.filter(F.split(F.upper(_bare(name, PREFIXES)), "[^A-Za-z0-9]+"), lambda x: x != "")
    kept = F.filter(words, lambda x: ~x.isin(*STOP_WORDS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def matching_label(name: Column) -> Column:
    return F.upper(F.replace(_bare(name, (*PREFIXES, "CUSTOM")), F.lit("_"), F.lit(" ")))


def _hits(label: Column, words: tuple[str, ...]) -> Column:
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(label, w))
    return F.size(found)


def relevance(name: Column) -> Column:
    """Keyword score: anchors, high and medium words add, low words subtract (less beside high ones)."""
    label = matching_label(name)
    anchor, high, medium, low = (_hits(label, w) for w in (ANCHOR_WORDS, HIGH_WORDS, MEDIUM_WORDS, LOW_WORDS))
    score = F.least(F.lit(10.0), anchor * 6.0) + F.least(F.lit(12.0), high * 3.0) + F.least(F.lit(6.0), medium * 2.0)
    score = score - F.when(high == 0, F.least(F.lit(8.0), low * 2.0)).otherwise(F.least(F.lit(2.0), low * 0.5))
    return score - F.when(label.rlike(r"\p{L}"), 0.0).otherwise(4.0)


def relevance_band(score: Column) -> Column:
    return F.when(score >= 6, "Disease-prioritized").when(score >= 2, "Supportive").otherwise("Background")


def family_score(priority: Column, jaccard: Column, programs: Column, sources: Column) -> Column:
    clip = lambda x, hi: F.greatest(F.lit(1), F.least(x, F.lit(hi)))
    return 2.0 * priority + 15.0 * F.greatest(jaccard, F.lit(0.0)) + 0.8 * clip(programs, 6) + 0.6 * clip(sources, 4)


def source_score(priority: Column, jaccard: Column, programs: Column, references: Column) -> Column:
    clip = lambda x, hi: F.greatest(F.lit(1), F.least(x, F.lit(hi)))
    return 2.0 * priority + 14.0 * F.greatest(jaccard, F.lit(0.0)) + 0.8 * clip(programs, 8) + 0.15 * clip(references, 12)


def numbered_duplicates(df, name: str, order: list, out: str):
    """Repeats of a name get _2, _3, ... in the given order."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn(out, F.when(k == 1, F.col(name)).otherwise(F.concat_ws("_", name, k.cast("string"))))


def claim_id(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("__", *parts), "[^A-Za-z0-9_]+", "_")


def slug(value: Column, default: str = "all_cells") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def bare_name(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def flag_or_null(value: Column) -> Column:
    """Boolean-like text; unknown text is null."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "1", "1.0", "yes", "y"), True).when(v.isin("false", "0", "0.0", "no", "n"), False)


def flag(value: Column) -> Column:
    """Boolean-like text with t and f; unknown text is false."""
    v = F.lower(F.trim(value.cast("string")))
    return F.coalesce(v.isin("true", "1", "1.0", "yes", "y", "t"), F.lit(False))


def sign_of(value: Column) -> Column:
    """-1, 0 or 1; 0 for null, NaN and infinite values."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(ok, F.signum(value)).otherwise(0.0).cast("int")


def family_display(key: Column) -> Column:
    """A family key in title case: a letter after anything but a letter is a capital."""
    parts = F.regexp_extract_all(F.lower(F.trim(key)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    title = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")
    return F.when(F.trim(key) == "", "Unlabeled family").otherwise(title)


def reference_keys(name: Column) -> Column:
    """The keys under which a set file may hold a saved label: the label, the term, the term with its source's prefix."""
    source, term = F.regexp_extract(name, r"(?s)\A(.*?)::", 1), after_source(name)
    plain = F.when(source.isin("WP", "KEGG", "REACTOME", "HALLMARK"), F.concat_ws("_", source, term))
    ontology = F.concat(F.replace(source, F.lit("_"), F.lit("")), F.lit("_"))
    ontology = F.when(source.isin("GO_BP", "GO_CC", "GO_MF"), F.when(F.startswith(term, ontology), term).otherwise(F.concat(ontology, term)))
    return F.when(name.contains("::"), F.array_distinct(F.array_compact(F.array(name, term, plain, ontology)))).otherwise(F.array(name))


def wrapped(text: Column, width: int = 28, mark: str = "<br>") -> Column:
    """Text of more than ``width`` characters in lines: between words, or cut where there are none."""
    cut, words = "\x1f", F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def add(done: Column, word: Column) -> Column:
        line = F.regexp_extract(done, rf"[^{cut}]*\z", 0)
        return F.concat(done, F.when(F.length(line) + 1 + F.length(word) <= width, " ").otherwise(cut), word)

    lines = F.aggregate(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(0))), F.coalesce(F.get(words, F.lit(0)), F.lit("")), add)
    pieces = F.regexp_replace(text, rf"(?s)(.{{{width}}})(?=.)", f"$1{cut}")
    out = F.when(F.length(text) <= width, text).when(text.contains(" "), lines).otherwise(pieces)
    return F.replace(out, F.lit(cut), F.lit(mark))


#: Fixed by the report format: prefixes of a program's matched label that name its source.
PROGRAM_SOURCES = {"GOBP": "GO BP", "KEGG": "KEGG", "HALLMARK": "HALLMARK", "REACTOME": "REACTOME", "CUSTOM": "CUSTOM"}


def program_parts(program: Column) -> tuple[Column, Column, Column]:
    """(head, source, phrase) of ``id__matched label``; the whole name is both where there is no label."""
    split = program.contains("__")
    head = F.when(split, F.regexp_extract(program, r"(?s)\A(.*?)__", 1)).otherwise(program)
    term = F.when(split, F.regexp_replace(program, r"(?s)\A.*?__", "")).otherwise(program)
    term = F.regexp_replace(F.regexp_replace(term, "::|-|/", "_"), "_{2,}", "_")
    known = "|".join(PROGRAM_SOURCES)
    found = F.regexp_extract(term, rf"\A({known})", 1)
    names = F.create_map(*[F.lit(x) for kv in PROGRAM_SOURCES.items() for x in kv])
    term = F.when(found == "", term).otherwise(F.regexp_replace(F.regexp_replace(term, rf"\A(?:{known})_?", ""), r"\A_+|_+\z", ""))
    phrase = F.array_join(F.filter(F.split(term, "_"), lambda x: x != ""), " ")
    phrase = F.when(phrase != "", phrase).otherwise(F.when(term != "", term).otherwise(program))
    return F.replace(head, F.lit("program_"), F.lit("P")), F.coalesce(F.element_at(names, F.nullif(found, F.lit(""))), F.lit("")), phrase


def shortened(phrase: Column, words: int, characters: int) -> Column:
    """The first words and characters of a phrase, with dots where something is left out."""
    tokens = F.filter(F.split(phrase, r"\s+"), lambda x: x != "")
    few = F.when(F.size(tokens) > words, F.concat(F.array_join(F.slice(tokens, 1, words), " "), F.lit(" ..."))).otherwise(phrase)
    return F.when(F.length(few) > characters, F.concat(F.rtrim(F.substring(few, 1, characters - 4)), F.lit(" ..."))).otherwise(few)


def program_display(program: Column, words: int | None = None, characters: int | None = None, axis: bool = False) -> Column:
    """A program's display name: whole, or shortened for selectors and axes."""
    head, source, phrase = program_parts(program)
    if words:
        phrase = shortened(phrase, words, characters)
    if axis:
        return F.concat(head, F.when(source != "", F.concat(F.lit(" ("), source, F.lit(")"))).otherwise(""), F.lit(" "), phrase)
    return F.concat(head, F.lit(" - "), F.when(source != "", F.concat(source, F.lit(": "))).otherwise(""), phrase)


def reference_display(name: Column, words: int = 6, characters: int = 48) -> Column:
    """A reference set's display name: the source in words, and the shortened term."""
    source = F.regexp_extract(name, r"(?s)\A(.*?)::", 1)
    term = F.filter(F.split(F.regexp_replace(after_source(name), "[/-]", "_"), "_"), lambda x: x != "")
    phrase = F.when(F.size(term) > 0, shortened(F.array_join(term, " "), words, characters)).otherwise(shortened(name, 1 << 20, characters))
    shown = F.when(source == "CUSTOM", "Custom").otherwise(source_display(source))
    return F.when(name.contains("::") & (source != ""), F.concat(shown, F.lit(": "), phrase)).otherwise(phrase)


def track_of(method: Column) -> Column:
    """Whether a method is led by curated sets."""
    return F.when(method.startswith("Curated-") | (method == "starCAT-Ref"), "reference_guided").otherwise("de_novo")
