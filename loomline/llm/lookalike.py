"""Problem 1: text that looks the same but is made of other characters, brought to one form.

Method: distinct suspicious tokens are exploded to positioned code points, a broadcast join with the
decomposition table and one with the look-alike table replace them, combining marks are ordered by class,
bases and marks recomposed, and the strings rebuilt.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Pairs of letters that look alike, one string above the other.
CYRILLIC_FORM = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһӏԁԛԝү"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXYGQWaesijopcyxhldqwy"
GREEK_FORM = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυκγϲϳ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXaivopukycj"
LATIN_FORM = "ɑɡıɩʏᴄᴏᴠᴡᴢꓑꓖ"
LATIN_AS_LATIN = "agiiycovwzPG"
ARMENIAN_FORM = "հոսցօՍՕ"
ARMENIAN_AS_LATIN = "hnugoUO"
CHEROKEE_FORM = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ"
CHEROKEE_AS_LATIN = "ABCDEGHJKLMPRSTVWZ"
LATIN_TWIN = "ABEKMHOPCTYXaeopcyx"
LATIN_AS_CYRILLIC = "АВЕКМНОРСТУХаеорсух"
# Letters of the Cyrillic block that ordinary Russian doesn't use but that look Latin.
ODD_CYRILLIC = "ЅІЈҮԌԚԜѕіјһӏԁԛԝү"
APOSTROPHES = "‘’‛ʼ′＇ʹʻ"
HYPHENS = "‐‑‒–−﹣－­"[:-1]
JOINERS = "‍︎️"
#: Class of conjoining vowels and trails: they stand with what is before them, behind its marks.
JOINED = 300
#: Kinds of compatibility decomposition that keep the look of a letter.
SAME_LOOK = {"<font>", "<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}

#: Anything a token of ordinary characters can't hold; such tokens and mixed or wholly ambiguous ones are looked at.
PLAIN = r"\x21-\x7EÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-žЀ-џ"
SUSPECT = rf"[^{PLAIN}]|[A-Za-zÀ-ž].*[Ѐ-џ]|[Ѐ-џ].*[A-Za-zÀ-ž]|[{ODD_CYRILLIC}]"
ALL_TWIN_CYRILLIC = "^[АВЕКМНОРСТУХаеорсух]+$"
ALL_TWIN_LATIN = f"^[{LATIN_TWIN}]+$"
SURE_CYRILLIC = "[БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгджзийклмнптфцчшщъыьэюяё]"
SURE_LATIN = "^[A-Za-zÀ-ž'-]*[bdfghijklmnqrstuvwzDFGIJLNQRSUVWZ]"


def _spread(ch: str) -> str:
    """Full decomposition of a character as far as its look stays the same."""
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    kind, *rest = d.split() if d[0] == "<" else ("", *d.split())
    parts = [chr(int(x, 16)) for x in rest]
    if kind and kind not in SAME_LOOK:
        return ch
    if not kind and len(parts) > 1 and any(unicodedata.combining(p) == 0 for p in parts[1:]):
        return ch  # starters only recompose with starters in a few scripts: left whole
    out = "".join(map(_spread, parts))
    if kind == "<compat>" and not all(c.isalnum() or unicodedata.combining(c) for c in out):
        return ch
    return out


def decomposition_rows() -> list[tuple[str, list[tuple[str, int]]]]:
    """(character, [(part, class)]) for every character that changes, is a mark or is unseen. Bounded by Unicode."""
    rows = []
    for n in range(0x80, sys.maxunicode + 1):
        ch = chr(n)
        kind = unicodedata.category(ch)
        if kind in ("Cs", "Co", "Cn"):
            continue
        if kind == "Cf" or ch == "͏" or 0xFE00 <= n <= 0xFE0F or kind == "Cc":
            rows.append((ch, [(ch, -1)]))
        elif kind in ("Zs", "Zl", "Zp"):
            rows.append((ch, [(" ", -2)]))
        elif ch in APOSTROPHES:
            rows.append((ch, [("'", 0)]))
        elif ch in HYPHENS:
            rows.append((ch, [("-", 0)]))
        else:
            out = _spread(ch)
            if out != ch or unicodedata.combining(ch):
                rows.append((ch, [(c, unicodedata.combining(c)) for c in out]))
            elif VOWELS[0] <= n <= VOWELS[1] or TRAILS[0] <= n <= TRAILS[1]:
                rows.append((ch, [(ch, JOINED)]))
    return [("\t", [(" ", -2)]), ("\n", [(" ", -2)]), ("\r", [(" ", -2)]), (" ", [(" ", -2)]), *rows]


def composition_rows() -> list[tuple[str, dict[str, str]]]:
    """(base, {character so far + mark: composed character}): for each base all that marks make of it step by step, from
    the primary composites of Unicode. Bounded by Unicode, as are the steps of one base."""
    pairs: dict[str, dict[str, str]] = {}
    for n in range(0x80, 0x30000):
        ch = chr(n)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and len(p := d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            base, mark = (chr(int(x, 16)) for x in p)
            if unicodedata.combining(mark) and not unicodedata.combining(base):
                pairs.setdefault(base, {})[mark] = ch

    def steps(base: str) -> dict[str, str]:
        out = {}
        for mark, ch in pairs.get(base, {}).items():
            out[base + mark] = ch
            out |= steps(ch)
        return out

    return [(base, steps(base)) for base in sorted(pairs)]


# Conjoining Hangul letters: first and last of leading consonants, vowels and trailing consonants, and the first syllable.
LEADS, VOWELS, TRAILS, SYLLABLES = (0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2), 0xAC00


def _hangul(base: Column, mark: Column) -> Column:
    """The syllable of a leading consonant and a vowel, or of a syllable without trail and a trailing consonant, by
    arithmetic; null for anything else."""
    b, m = F.ascii(base), F.ascii(mark)
    vowels, trails = VOWELS[1] - VOWELS[0] + 1, TRAILS[1] - TRAILS[0] + 2
    lead = b.between(*LEADS) & m.between(*VOWELS)
    open_ = b.between(SYLLABLES, SYLLABLES + (LEADS[1] - LEADS[0] + 1) * vowels * trails - 1) & ((b - SYLLABLES) % trails == 0) & m.between(*TRAILS)
    code = F.when(lead, ((b - LEADS[0]) * vowels + (m - VOWELS[0])) * trails + SYLLABLES).when(open_, b + m - (TRAILS[0] - 1))
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def read_confusables(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """(character, Latin letter) pairs of a table in the format of Unicode's confusables ('0261 ; 0067 ; MA # ...'), as far
    as one character stands for one basic Latin letter. The public table has some 6,000 lines."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*[0-9A-Fa-f]{4,6}\s*;\s*[0-9A-Fa-f]{4}\s*;"))
    codes = [r.value.split(";")[:2] for r in lines.collect()]
    pairs = [(chr(int(a.strip(), 16)), chr(int(b.strip(), 16))) for a, b in codes]
    return tuple(sorted({(a, b) for a, b in pairs if not a.isascii() and b.isascii() and b.isalpha() and a.isalpha()}))


def _alike_rows(more: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, str, str, int, int, int]]:
    """(character, in Latin, in Cyrillic, surely Latin, surely Cyrillic, odd); ``more`` adds look-alikes of Latin letters."""
    foreign = GREEK_FORM + LATIN_FORM + ARMENIAN_FORM + CHEROKEE_FORM + "".join(c for c, _ in more)
    latin = dict(more) | dict(zip(CYRILLIC_FORM + GREEK_FORM + LATIN_FORM + ARMENIAN_FORM + CHEROKEE_FORM, CYRILLIC_AS_LATIN + GREEK_AS_LATIN + LATIN_AS_LATIN + ARMENIAN_AS_LATIN + CHEROKEE_AS_LATIN, strict=True))
    cyrillic = dict(zip(LATIN_TWIN, LATIN_AS_CYRILLIC, strict=True))
    rows = []
    letters = {*latin, *cyrillic, *map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B)), *map(chr, range(0x400, 0x530)), *map(chr, range(0xC0, 0x250))}
    for c in sorted(letters):
        if not c.isalpha():
            continue
        is_cyrillic = 0x400 <= ord(c) < 0x530
        is_latin = ord(c) < 0x250
        odd = c in ODD_CYRILLIC or c in foreign
        rows.append((c, latin.get(c), cyrillic.get(latin.get(c, c)), int(is_latin and c not in cyrillic and not odd), int(is_cyrillic and c not in latin), int(odd)))
    return rows


def _tables(spark: SparkSession, more: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    decomp = spark.createDataFrame(decomposition_rows(), "ch string, parts array<struct<c string, ccc int>>")
    alike = spark.createDataFrame(_alike_rows(more), "c string, latin string, cyrillic string, sure_latin int, sure_cyrillic int, odd int")
    return decomp, alike, spark.createDataFrame(composition_rows(), "base string, steps map<string,string>")


def _context(tokens: Column, pos: Column) -> Column:
    """'C' where the tokens around (two on each side) are surely Cyrillic more often than surely Latin, else 'L'."""
    around = F.slice(tokens, F.greatest(pos - 1, F.lit(1)), F.lit(5))
    count = lambda pattern: F.size(F.filter(around, lambda t: t.rlike(pattern)))
    return F.when(count(SURE_CYRILLIC) > count(SURE_LATIN), "C").otherwise("L")


def suspects(df: DataFrame, id_col: str = "ord", tokens_col: str = "tokens") -> DataFrame:
    """(id, pos, token, ctx) of every token that may have to change, once per (id, pos). ctx matters only for
    tokens all of whose letters exist in both scripts."""
    toks = F.col(tokens_col)
    twin = lambda t: t.rlike(ALL_TWIN_CYRILLIC) | t.rlike(ALL_TWIN_LATIN)
    any_cyrillic = F.exists(toks, lambda t: t.rlike("[Ѐ-џ]"))
    wanted = lambda t: t.rlike(SUSPECT) | (any_cyrillic & twin(t))
    from loomline.plans.lineage import spread_small

    rows = spread_small(df.select(F.col(id_col), toks.alias("tokens")).where(F.col(id_col).isNotNull()))
    rows = rows.where(F.exists("tokens", lambda t: t.rlike(f"{SUSPECT}|{ALL_TWIN_CYRILLIC}")) | F.exists("tokens", lambda t: t.rlike("[Ѐ-џ]")))
    picked = rows.select(id_col, "tokens", F.posexplode("tokens").alias("pos", "token")).where(F.col("token").isNotNull() & wanted(F.col("token")))
    return picked.select(id_col, "pos", "token", F.when(twin(F.col("token")), _context(F.col("tokens"), F.col("pos"))).otherwise("L").alias("ctx")).dropDuplicates([id_col, "pos"])


def canonical_forms(tokens: DataFrame, more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(token, ctx, canon) for the distinct (token, ctx) of the input. A null token gives no row, an empty one stays empty.
    ``more``: further look-alikes of Latin letters, as ``read_confusables`` gives them."""
    spark = tokens.sparkSession
    decomp, alike, composed = _tables(spark, more)
    chars = tokens.where("token is not null").select("token", "ctx", F.posexplode(F.split("token", "")).alias("p", "ch"))
    parts = chars.join(F.broadcast(decomp), "ch", "left").select("token", "ctx", "p", "ch", F.posexplode(F.coalesce("parts", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"))))).alias("q", "x"))
    parts = parts.select("token", "ctx", "p", "q", F.col("x.c").alias("c"), F.col("x.ccc").alias("ccc")).join(F.broadcast(alike), "c", "left")
    one = Window.partitionBy("token", "ctx")
    in_order = one.orderBy("p", "q").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(one)
    parts = parts.select(
        "token", "ctx", "p", "q", "c", "ccc", "latin", "cyrillic",
        total("sure_latin").alias("nl"), total("sure_cyrillic").alias("nc"), total("odd").alias("no"),
        F.sum((F.col("c").rlike(r"^\p{L}$") | F.col("c").rlike(r"^[A-Za-z]$")).cast("int")).over(one).alias("letters"),
        F.sum(F.col("c").rlike(r"^[A-Za-zÀ-ɏ]$").cast("int")).over(one).alias("latins"),
        F.sum((F.col("ccc") <= 0).cast("int")).over(in_order).alias("cluster"),
    )
    tag = F.col("token").rlike("^[#@＃＠]")
    script = (
        F.when(F.col("nc") > F.col("nl"), "C").when(F.col("nl") > F.col("nc"), "L").when((F.col("no") > 0) & ((F.col("latins") > 0) | (F.col("letters") > 1) & (F.col("nc") == 0)), "L")
        .when(tag, "L").when(F.col("letters") == 0, "-").otherwise(F.col("ctx"))
    )
    signs = (F.col("latins") == 0) & (F.col("letters") <= 1) & F.col("c").rlike(r"^\p{IsGreek}$")  # a Greek letter alone is a sign
    unseen = (F.col("ccc") == -1) & ((F.col("letters") > 0) | ~F.col("c").isin(*JOINERS))
    out = (
        F.when(unseen, F.lit("")).when(signs, F.col("c"))
        .when(script == "L", F.coalesce("latin", "c")).when(script == "C", F.coalesce("cyrillic", "c")).otherwise(F.col("c"))
    )
    parts = parts.select("token", "ctx", "p", "q", "cluster", "ccc", out.alias("c"))
    clusters = parts.groupBy("token", "ctx", "cluster").agg(F.sort_array(F.collect_list(F.struct(F.greatest("ccc", F.lit(0)).alias("k"), "p", "q", "c"))).alias("xs"))
    start = F.struct(F.element_at("xs", 1)["c"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def compose(acc: Column, x: Column) -> Column:
        joined = F.coalesce(F.element_at("steps", F.concat(acc["base"], x["c"])), _hangul(acc["base"], x["c"]))
        free = (acc["rest"] == "") | (acc["last"] < x["k"])
        return F.when(free & joined.isNotNull(), F.struct(joined.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last"))).otherwise(
            F.struct(acc["base"].alias("base"), F.concat(acc["rest"], x["c"]).alias("rest"), x["k"].alias("last"))
        )

    folded = F.aggregate(F.slice("xs", F.lit(2), F.greatest(F.size("xs") - 1, F.lit(0))), start, compose, lambda a: F.concat(a["base"], a["rest"]))
    text = F.when(F.size("xs") == 1, F.element_at("xs", 1)["c"]).otherwise(folded)
    # The steps of each cluster's base come by a broadcast join; marks that stand alone keep null.
    clusters = clusters.withColumn("base", F.element_at("xs", 1)["c"]).join(F.broadcast(composed), "base", "left")
    built = clusters.select("token", "ctx", "cluster", text.alias("s")).groupBy("token", "ctx").agg(F.sort_array(F.collect_list(F.struct("cluster", "s"))).alias("ss"))
    joined = F.array_join(F.transform("ss", lambda x: x["s"]), "")
    return built.select("token", "ctx", F.trim(F.regexp_replace(joined, " +", " ")).alias("canon"))


def found(df: DataFrame, id_col: str = "ord", tokens_col: str = "tokens") -> DataFrame:
    """(id, pos) of each entry that isn't written in the ordinary characters of its own language but looks like
    a word, tag or name that is. Null or empty token lists give no rows; repeated ids count once."""
    marked = suspects(df, id_col, tokens_col)
    forms = canonical_forms(marked.select("token", "ctx").distinct())
    changed = forms.where((F.col("canon") != F.col("token")) & F.col("canon").rlike(r"\p{L}"))
    return marked.join(changed, ["token", "ctx"], "left_semi").select(id_col, "pos")


def normalise_tokens(df: DataFrame, id_col: str = "ord", tokens_col: str = "tokens") -> DataFrame:
    """(id, tokens) once per id with every token in its canonical form.

    Only records with a suspicious token are taken apart; the others pass through untouched. A null list stays
    null, an empty one empty; null entries stay in place. Repeated ids count once. Other columns of the input
    aren't looked at, whatever their names.
    """
    from loomline.plans.lineage import once_per_key

    rows = once_per_key(df.select(F.col(id_col), F.col(tokens_col).alias("tokens")), id_col)
    marked = suspects(rows, id_col, "tokens")
    forms = canonical_forms(marked.select("token", "ctx").distinct())
    changed = marked.join(forms, ["token", "ctx"]).where("canon <> token").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("pos", "canon"))).alias("fixes"))
    joined = rows.join(changed, id_col, "left")
    fixed = F.transform("tokens", lambda t, i: F.coalesce(F.element_at("fixes", i), t))
    return joined.select(id_col, F.when(F.col("fixes").isNull(), F.col("tokens")).otherwise(fixed).alias("tokens"))
