"""Record-level functions as Columns: views, keys, comparison forms, classes, glosses."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import soft_keys

#: Letters of the second script's transliteration.
SCRIPT_PAIRS = (("þ", "th"), ("χ", "ch"), ("φ", "ph"), ("ś", "s"), ("š", "s"), ("θ", "th"), ("ϑ", "th"))
#: Letters of the printed index.
INDEX_PAIRS = (
    ("ϑ", "th"), ("&", "th"), ("θ", "th"), ("χ", "ch"), ("φ", "ph"), ("ç", "c"), ("ś", "s"), ("š", "s"), ("σ", "s"), ("ς", "s"),
    ("α", "a"), ("ν", "v"), ("µ", "m"), ("μ", "m"), ("é", "e"), ("è", "e"),
)
#: Glyphs that stand for parts of a Roman numeral.
ROMAN_PAIRS = (("Χ", "X"), ("Π", "II"), ("Ι", "I"), ("У", "V"), ("U", "II"), ("H", "II"), ("l", "I"), ("i", "I"), ("1", "I"), ("В", "B"))
#: The numbered columns.
COLUMNS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
#: Token flags that make a reading unclean.
UNCLEAN = ("damaged", "uncertain", "restored", "emended")
#: Classes of ritual words, the first that fits: (class, whole words, beginnings).
RITUAL = (
    ("VACL", ("vacl",), ()),
    ("OFFER", ("fler", "flere", "vinum", "fasei", "faseic"), ("zusle", "thapn", "zuslev", "racuse")),
    ("THEO", ("tin", "tins", "tinsi", "tinsin", "uni", "unialti", "lusa", "lusas", "veive", "veives", "aiser", "aiseras", "seus", "nethuns", "nethunsl", "crap", "crapsti", "catha", "cel"), ("nethuns", "crapst")),
    ("VERB-R", ("ara",), ("nunthen", "thezi", "thezer", "scanin", "sin", "acil", "trin", "hechs", "hex")),
    ("CAL", (), ("zathrum", "eslem", "acal", "celi", "tiur")),
    ("CONJ", ("etnam",), ()),
)


def _replace(text: Column, pairs: tuple) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _marked() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by canonical decomposition."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x250)}
    parts = {c: d for c, d in parts.items() if len(d) > 1 and d[0].isascii()}
    return "".join(parts), "".join(d[0] for d in parts.values())


def bare(text: Column) -> Column:
    """text without the marks of Latin letters, composed or combining."""
    return F.regexp_replace(F.translate(text, *_marked()), r"\p{M}", "")


def norm_any(word: Column, pairs: tuple = SCRIPT_PAIRS) -> Column:
    """Lower case, the script's letters mapped, marks dropped, a-z kept."""
    return F.regexp_replace(bare(_replace(F.lower(F.coalesce(word, F.lit(""))), pairs)), "[^a-z]", "")


def norm_word(word: Column) -> Column:
    """An index word's comparison form; other marked letters vanish."""
    return F.regexp_replace(_replace(F.lower(F.trim(F.coalesce(word, F.lit("")))), INDEX_PAIRS), "[^a-z]", "")


def fix_roman(token: Column) -> Column:
    """The column number a misread token stands for, or null."""
    fixed = _replace(token, ROMAN_PAIRS)
    return F.when(fixed.isin(*COLUMNS), fixed)


def to_theta(word: Column) -> Column:
    """ASCII digraphs as the letters of the printed edition."""
    return _replace(word, (("th", "ϑ"), ("ch", "χ"), ("ph", "φ")))


def clean_reading(value: Column) -> Column:
    """The displayed reading of a wiki value: link targets, second alternatives, controls and template blanks go."""
    hold, blank = "\ue000", "\u00a0"
    out = F.regexp_replace(value, r"(^|[\s:·/])([^\s:·/!]+)!", "$1")
    out = F.replace(F.regexp_replace(out, r"(?<=\S)!\S+", ""), F.lit("!"), F.lit(""))
    out = F.replace(F.regexp_replace(out, r"(?<!\S)space(?!\S)", hold), F.lit(blank), F.lit(hold))
    return F.replace(F.regexp_replace(out, r"\s+", ""), F.lit(hold), F.lit(blank))


def pre_clean(text: Column, keep: str, junk: str = "") -> Column:
    """An OCR line in the conventions of marked text: braces' content goes, ~ is a gap, unknown signs are lost letters, letters are upper-cased.

    keep: characters that stay as they are; junk: letters that are lost too.
    """
    quote = lambda s: "".join(f"\\{c}" if not c.isalnum() and ord(c) < 128 else c for c in s)
    out = F.replace(F.regexp_replace(text, r"\{[^}]*\}", " "), F.lit("~"), F.lit(" [---] "))
    out = F.regexp_replace(out, rf"[^{quote(keep)}\p{{L}}]", "-")
    if junk:
        out = F.regexp_replace(out, f"[{quote(junk)}]", "-")
    out = F.transform(F.split(out, ""), lambda c: F.when(F.contains(F.lit(keep), c), c).otherwise(F.upper(c)))
    out = F.regexp_replace(F.replace(F.array_join(out, ""), F.lit("+"), F.lit("-")), r"\(\s*T", "ś")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[()]", ""), r"\s+", " "))


def glue(tokens: Column, known: Column) -> Column:
    """Tokens with a one-letter remnant joined to its left neighbour where the join is a known form and the neighbour is not.

    known: map of known forms. Joins are made from left to right.
    """
    mark = lambda t: F.regexp_replace(t, r"[\[\]<>•.\-/ ]", "")
    has = lambda t: F.coalesce(F.try_element_at(known, F.lower(t)), F.lit(False))

    def step(done, t):
        last = F.get(done, F.size(done) - 1)
        fits = (F.length(mark(t)) == 1) & F.rlike(t, F.lit(r"^\p{L}$")) & (F.length(mark(last)) >= 3) & has(F.concat(mark(last), t)) & ~has(mark(last))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, t)))).otherwise(F.concat(done, F.array(t)))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def region_of(siglum: Column, known: tuple, pattern: str = r"^ET[12] ([A-Za-z]+)[ .]") -> Column:
    """The region code in a siglum, null where there is none or it is not known."""
    code = F.regexp_extract(F.concat(siglum, F.lit(" ")), pattern, 1)
    return F.when(code.isin(*known), code)


def ladder(word: Column, table: tuple = RITUAL, other: str = "X") -> Column:
    """The first class of a table (class, whole words, beginnings) that fits a word."""
    out = F
    for name, whole, begins in table:
        tests = [word.isin(*whole)] * bool(whole) + [F.startswith(word, F.lit(b)) for b in begins]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        out = out.when(hit, name)
    return out.otherwise(other)


def genre_of(ws: Column, genres: tuple, special: Column | None = None, name: str = "ritual", other: str = "other") -> Column:
    """special records first, then the first genre (name, words) of which a record has a word."""
    out = F.when(special, name) if special is not None else F
    for genre, ws_of in genres:
        out = out.when(F.arrays_overlap(ws, F.array(*map(F.lit, ws_of))), genre)
    return out.otherwise(other)


def gloss_hit(concept: Column, glosses: Column) -> Column:
    """Whether a gloss contains a word of at least three letters of the concept."""
    keys = F.array_distinct(F.regexp_extract_all(F.lower(concept), F.lit("[a-z]{3,}"), F.lit(0)))
    return F.exists(glosses, lambda g: F.exists(keys, lambda k: F.contains(g, k)))


def quoted(text: Column) -> Column:
    """The glosses between single quotes, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit("'([^']+)'"), F.lit(1)), F.lower)


def artifact_of(source: Column, key: Column, alias: Column, fixed: dict) -> Column:
    """One key for all readings of an object: a source's own object, then an alias, then source and key."""
    out = F
    for name, value in fixed.items():
        out = out.when(source == name, value)
    own = F.concat_ws(":", source, key.cast("string"))
    return out.otherwise(F.coalesce(alias, own)) if fixed else F.coalesce(alias, own)


def token_flags(raw: Column) -> Column:
    """Flags of a raw token by its marks."""
    marks = ((r"-", "damaged"), (r"\?", "uncertain"), (r"[\[\]]", "restored"), (r"[<>]", "emended"))
    return F.array_compact(F.array(*[F.when(F.rlike(raw, F.lit(p)), name) for p, name in marks]))


def is_clean(raw: Column) -> Column:
    """No unclean flag and at least two characters."""
    return ~F.arrays_overlap(token_flags(raw), F.array(*map(F.lit, UNCLEAN))) & (F.length(raw) >= 2)


def split_suffix(word: Column, endings: tuple, stem: int = 3) -> Column:
    """struct<stem, suffix> by the longest of the endings that leaves a stem, or null."""
    out = F
    for e in sorted(endings, key=lambda x: (-len(x), x)):
        out = out.when(F.endswith(word, F.lit(e)) & (F.length(word) - len(e) >= stem), F.struct(F.left(word, F.length(word) - len(e)).alias("stem"), F.lit(e).alias("suffix")))
    return out


def apparatus(text: Column) -> Column:
    """struct<n, lemma, note> of a line `N lemma ] note`, null elsewhere."""
    pattern = r"^\s*(\d+)\s+(.+?)\s*\](?:\s*)(.*)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(F.rlike(text, F.lit(pattern)), F.struct(part(1).cast("int").alias("n"), part(2).alias("lemma"), part(3).alias("note")))


def index_entry(entry: Column) -> Column:
    """array<struct<head, col, line>> of an index entry `head I 3, 5; II 7`: each line number with the last column number before it."""
    head = F.regexp_extract(entry, r"^(\S+)", 1)
    parts = F.regexp_extract_all(F.regexp_replace(entry, r"^\S+\s*", ""), F.lit(r"[IVX]+|\d+"), F.lit(0))

    def step(state, p):
        number = F.rlike(p, F.lit(r"^\d"))
        item = F.struct(head.alias("head"), state["col"].alias("col"), p.try_cast("int").alias("line"))
        return F.struct(F.when(number, state["col"]).otherwise(p).alias("col"), F.when(number, F.concat(state["out"], F.array(item))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("col"), F.array().cast("array<struct<head:string,col:string,line:int>>").alias("out"))
    return F.aggregate(parts, start, step, lambda s: s["out"])


def healed(rows: Column, ahead: int = 300, back: int = 50) -> Column:
    """Numbered rows array<struct<num, line, text>>, in reading order, with torn numbers rejoined.

    Numbers should rise. A smaller one is joined with the line number behind it
    if that gives a number at most `ahead` beyond the greatest so far and the
    text begins with a line number; else a step back of at most `back` is
    accepted, and others are dropped.
    """
    inner = r"^(\d{1,2})\s+(\S.*)$"

    def step(state, r):
        prev = state["prev"]
        joined = F.concat(r["num"].cast("string"), r["line"].cast("string")).try_cast("int")
        torn = (r["num"] < prev) & (joined >= prev) & (joined <= prev + ahead) & F.rlike(r["text"], F.lit(inner))
        keep = torn | (r["num"] >= prev - back)
        row = F.struct(
            F.when(torn, joined).otherwise(r["num"]).alias("num"), F.when(torn, F.regexp_extract(r["text"], inner, 1).try_cast("int")).otherwise(r["line"]).alias("line"),
            F.when(torn, F.regexp_extract(r["text"], inner, 2)).otherwise(r["text"]).alias("text"),
        )
        return F.struct(F.when(keep, F.greatest(prev, row["num"])).otherwise(prev).alias("prev"), F.when(keep, F.concat(state["out"], F.array(row))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("prev"), F.array().cast("array<struct<num:int,line:int,text:string>>").alias("out"))
    return F.aggregate(rows, start, step, lambda s: s["out"])


def first_free(a: list, b: list, keys) -> list:
    """For each of a's words, in order, the place of b's first free word that shares a key with it, else None."""
    places, free, out = {}, [True] * len(b), []
    for j in range(len(b) - 1, -1, -1):
        for k in keys(b[j]):
            places.setdefault(k, []).append(j)
    for w in a:
        best = None
        for k in keys(w):
            at = places.get(k)
            while at and not free[at[-1]]:
                at.pop()
            if at and (best is None or at[-1] < best):
                best = at[-1]
        if best is not None:
            free[best] = False
        out.append(best)
    return out


def soft_jaccard(a: Column, b: Column, same) -> Column:
    """Greedy matching of a's words, in order, to b's first free word that is the same(x, y); matches over all words less matches.

    same has keys(word): words are the same if they share one, so free words are found by key.
    """
    keys = same.keys

    @F.pandas_udf("int")
    def hits(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else sum(j is not None for j in first_free(x.tolist(), y.tolist(), keys)) for x, y in zip(xs, ys)], dtype="Int32")

    free = F.sort_array(F.array_distinct(b))
    hit = hits(a, free)
    # Words of a beyond their first matches count as unmatched; b counts once each.
    size = F.size(a) + F.size(free)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(hit / (size - hit))


def paired(a: Column, b: Column) -> Column:
    """struct<n_exact, n_soft, left, right>: two word lists matched one to one, by equal words, then by soft equal ones; what stays on either side."""

    @F.pandas_udf("struct<n_exact:int,n_soft:int,left:array<string>,right:array<string>>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(xs, ys):
            left, right, counts = list(x), list(y), []
            for keys in (lambda w: (w,), soft_keys):
                at = first_free(left, right, keys)
                taken = {j for j in at if j is not None}
                left, right = [w for w, j in zip(left, at) if j is None], [w for j, w in enumerate(right) if j not in taken]
                counts.append(len(taken))
            rows.append((*counts, left, right))
        return pd.DataFrame(rows, columns=["n_exact", "n_soft", "left", "right"])

    return run(a, b)


def greedy(a: Column, b: Column, same) -> Column:
    """struct<rest, left, hit>: a's words, in order, each take b's first free word that is the same(x, y); what stays on either side, and the matches."""

    def step(state, w):
        at = F.coalesce(F.array_position(F.transform(state["rest"], lambda v: same(w, v)), True), F.lit(0)).cast("int")
        rest = F.concat(F.slice(state["rest"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(state["rest"], at + 1, F.size(state["rest"])))
        return F.struct(
            F.when(at > 0, rest).otherwise(state["rest"]).alias("rest"), F.when(at > 0, state["left"]).otherwise(F.concat(state["left"], F.array(w))).alias("left"), (state["hit"] + (at > 0).cast("int")).alias("hit")
        )

    return F.aggregate(a, F.struct(b.alias("rest"), F.array().cast("array<string>").alias("left"), F.lit(0).alias("hit")), step)
