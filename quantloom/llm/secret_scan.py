"""Operator 4: secrets by pattern, and by entropy in sliding windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import common

#: Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "entropy")
WORDS = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Maximal runs, so the same matches as those of [0-9a-f]+ that are long enough.
HEX = r"[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Candidates that are suppressed: addresses, runs without digits or without letters, UUIDs, times, numbered files.
ALLOWED = (
    r"^//", r"^www\.", r"^[^0-9]*$", r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9.]+Z?$",
    r"^[A-Za-z_./-]+[0-9]{1,4}(\.[A-Za-z]{1,5})?[.-]*$",
)


@dataclass(frozen=True)
class EntropyLimits:
    """Least bits of the best window of `window` characters, by the class of the whole candidate."""

    window: int = 20
    hex_bits: float = 3.0
    alnum_bits: float = 3.6
    any_bits: float = 3.7


def _matches(text: str, pattern: str, kind: int, keep: str) -> str:
    """SQL for an array of (start, kind, end) of the matches for which `keep` holds (`0`: the gap before, `1`: the match, `2`: its group 2)."""
    p = "r'" + pattern.replace("'", r"\x27") + "'"
    group = 2 if kind == 0 else 0
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"
    # The last gap has no match after it: its m is null.
    step = f"""named_struct('at', a.at + char_length(x.`0`) + coalesce(char_length(x.`1`), 0),
      'found', if(x.`1` is not null and {keep}, array_append(a.found, named_struct('start', a.at + char_length(x.`0`), 'kind', {kind}, 'end', a.at + char_length(x.`0`) + char_length(x.`1`), 'value', x.`1`)), a.found))"""
    return f"aggregate({zipped}, named_struct('at', 0, 'found', cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)), (a, x) -> {step}, a -> a.found)"


def _best_entropy(value: str, window: int) -> str:
    """SQL for the highest Shannon entropy, in bits, of any window of the string.

    One pass: the character that enters and the one that leaves change their counts, and the sum of
    c * log2(c) changes by the difference for those counts alone.
    """
    codes = f"transform(split({value}, ''), c -> locate(c, '{ALPHABET}'))"
    zipped = f"zip_with({codes}, concat(array_repeat(0, {window}), {codes}), (n, o) -> named_struct('n', n, 'o', o))"
    f = lambda c: f"if({c} > 1, {c} * log2({c}), 0D)"
    into, off = "coalesce(get(a.c, x.n), 0)", "if(x.n = x.o, coalesce(get(a.c, x.o), 0) + 1, get(a.c, x.o))"
    entered = f"a.s + {f(f'({into} + 1)')} - {f(into)}"
    s = f"if(x.o > 0, {entered} + {f(f'({off} - 1)')} - {f(off)}, {entered})"
    counts = "transform(a.c, (k, i) -> k + if(i = x.n, 1, 0) - if(i = x.o and x.o > 0, 1, 0))"
    step = f"named_struct('c', {counts}, 's', {s}, 'i', a.i + 1, 'b', if(a.i + 1 >= {window}, greatest(a.b, log2({window}) - ({s}) / {window}), a.b))"
    start = f"named_struct('c', array_repeat(0, {len(ALPHABET) + 1}), 's', 0D, 'i', 0, 'b', 0D)"
    return f"aggregate(filter({zipped}, x -> x.n is not null), {start}, (a, x) -> {step}, a -> a.b)"


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def with_spans(docs: DataFrame, limits: EntropyLimits = EntropyLimits(), text_column: str = "text", base: str = "secret_base", spans: str = "secret_spans") -> DataFrame:
    """Adds the columns `base` and `spans`: arrays of (start, kind, end), in order.

    Positions are code points, ends exclusive; kinds index KINDS. Base spans are whole matches.
    Candidates for entropy are maximal runs of the 68 characters of ALPHABET, as long as a window or
    longer, that overlap no base span and match no pattern of ALLOWED; one is a secret if some window
    of it reaches its class's bits. Null texts are empty and have no spans. Repeated rows are kept.
    """
    text = "__secret_text"
    out = docs.withColumn(text, common.empty_text(text_column))
    none = "cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)"
    candidates = f"[A-Za-z0-9+/_.=-]{{{limits.window},}}"
    # A cheap look first; most texts hold none of the kinds.
    found = {
        "assign": f"if({text} rlike r'{WORDS}', {_matches(text, ASSIGN, 0, 'char_length(x.`2`) >= 8')}, {none})",
        "access": f"if(contains({text}, 'AKIA'), {_matches(text, ACCESS, 1, 'char_length(x.`1`) >= 16')}, {none})",
        "hex": f"if({text} rlike '{HEX}', {_matches(text, HEX, 2, 'true')}, {none})",
        "runs": f"if({text} rlike '{candidates}', {_matches(text, candidates, 3, 'true')}, {none})",
    }
    out = out.withColumns({f"__secret_{k}": F.expr(v) for k, v in found.items()}).drop(text)
    out = out.withColumn("__secret_base", F.expr("array_sort(concat(__secret_assign, __secret_access, __secret_hex))"))
    allowed = " or ".join(f"r.value rlike r'{p}'" for p in ALLOWED)
    out = out.withColumn("__secret_runs", F.expr(f"filter(__secret_runs, r -> not ({allowed}) and not exists(__secret_base, b -> b.start < r.end and r.start < b.end))"))
    bits = f"case when r.value rlike '^[0-9a-fA-F]+$' then {limits.hex_bits}D when r.value rlike '^[A-Za-z0-9]+$' then {limits.alnum_bits}D else {limits.any_bits}D end"
    out = out.withColumn("__secret_runs", F.expr(f"filter(__secret_runs, r -> {_best_entropy('r.value', limits.window)} >= {bits})"))
    bare = "s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end)"
    out = out.withColumn(spans, F.expr(f"transform(array_sort(concat(__secret_base, __secret_runs)), {bare})"))
    out = out.withColumn(base, F.expr(f"transform(__secret_base, {bare})"))
    return out.drop("__secret_base", "__secret_runs", *(f"__secret_{k}" for k in found))


def secret_report(docs: DataFrame, limits: EntropyLimits = EntropyLimits(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: its id, how many spans of each kind, a digest of the base spans, all spans."""
    rows = with_spans(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), limits)
    counts = [F.expr(f"size(filter(secret_spans, s -> s.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined("secret_base"), 256).alias("base_sha256"), _joined("secret_spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", limits: EntropyLimits = EntropyLimits(), text_column: str = "text") -> DataFrame:
    """The same rows and columns, with the union of a text's spans replaced by `mark`, overlapping
    spans by one. Texts without a secret, null ones too, stay as they are."""
    out = with_spans(docs, limits, text_column, "__secret_b", "__secret_s")
    step = """named_struct('at', greatest(a.at, s.end), 'out', concat(a.out,
      if(s.start >= a.at, concat(substring(__secret_text, a.at + 1, s.start - a.at), :mark), '')))""".replace(":mark", "'" + mark.replace("'", "\\'") + "'")
    # A span at the very start has start 0 = at; later ones count as new unless they begin before `at`.
    cut = f"aggregate(__secret_s, named_struct('at', 0, 'out', ''), (a, s) -> {step}, a -> concat(a.out, substring(__secret_text, a.at + 1)))"
    out = out.withColumn("__secret_text", F.col(text_column))
    out = out.withColumn(text_column, F.when(F.size("__secret_s") > 0, F.expr(cut)).otherwise(F.col(text_column)))
    return out.select(*docs.columns)
