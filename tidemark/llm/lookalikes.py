"""Texts that look the same but are made of other characters, brought to one spelling."""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

# Letters that look alike, each group after the Latin letter (or sign) they look like.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "Ԍ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ",
    "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ",
    "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "УҮΥ", "Z": "ΖᏃ",
    "a": "аɑα", "b": "ЬᏏ", "c": "сϲ", "d": "ԁᏧ", "e": "еҽ", "g": "ցɡ", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "κк",
    "l": "ӏ", "n": "ոη", "o": "оοօσ", "p": "рρ", "q": "ԛզ", "r": "гᴦ", "s": "ѕꜱ", "u": "սυʋᴜ", "v": "ѵνᴠ", "w": "ԝաᴡ",
    "x": "хχ", "y": "уүγ", "z": "ᴢ",
    "П": "Π", "Г": "Γ", "Ф": "Φ", "п": "πᴨ", "ф": "φɸ", "3": "ЗӠ", "6": "б",
    "-": "‐‑‒–⁃−˗", "'": "’‘ʼʹ′՚", ".": "․",
    ",": "‚٫", ":": "։꞉", "/": "⁄∕", "&": "﹠",
}
#: Decompositions that change the width or the joining of letters, not what they are.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: What is drawn like nothing, besides the format characters (category Cf).
UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0} | {*range(0xFE00, 0xFE10)} | {*range(0x180B, 0x1810)}


def _letter_classes() -> dict[str, str]:
    classes = {}
    for head, others in LOOKALIKES.items():
        for ch in others:
            classes[ch] = head
    # capital and small forms that are drawn as one bar
    classes["I"] = classes["|"] = "l"
    return {ch: classes.get(head, head) for ch, head in classes.items()}


CLASSES = _letter_classes()


@functools.cache
def _open(ch: str) -> str:
    """``ch`` in its parts as they are drawn: width, joining and ligatures undone, accents apart, blanks plain."""
    kind = unicodedata.category(ch)
    if kind == "Cf" or ord(ch) in UNSEEN:
        return ""
    if kind == "Zs":
        return " "
    parts = unicodedata.decomposition(ch)
    if not parts:
        return ch if not 0xAC00 <= ord(ch) <= 0xD7A3 else unicodedata.normalize("NFD", ch)
    tag, *codes = parts.split()
    if not tag.startswith("<"):
        codes = [tag, *codes]
    elif tag not in SAME_LOOK and not (tag == "<compat>" and len(codes) > 1 and all(unicodedata.category(chr(int(c, 16)))[0] == "L" for c in codes)):
        return ch  # a compatible single letter, as the lunate sigma, has a look of its own
    return "".join(_open(chr(int(c, 16))) for c in codes)


def drawn(text: str) -> str:
    """The characters of ``text`` as they are drawn, accents apart and in one order."""
    return unicodedata.normalize("NFD", "".join(map(_open, text)))


def look(text: str) -> str:
    """Equal for texts that may look the same; ``alike`` decides."""
    return "".join(CLASSES.get(ch, ch) for ch in drawn(text))


def alike(one: str, other: str) -> bool:
    """Whether two texts look the same: plain (ASCII) characters must be equal, others may be look-alikes."""
    a, b = drawn(one), drawn(other)
    return len(a) == len(b) and all(
        x == y or (CLASSES.get(x, x) == CLASSES.get(y, y) and not (x < "\x80" and y < "\x80")) for x, y in zip(a, b)
    )


#: Scripts that are written together.
JAPANESE = {"HIRAGANA", "KATAKANA", "HALFWIDTH", "KATAKANA-HIRAGANA"}


@functools.cache
def script(ch: str) -> str:
    """The script of a letter by its Unicode name; empty for what belongs to no script."""
    if unicodedata.category(ch)[0] != "L":
        return ""
    name = unicodedata.name(ch, "").split(" ")[0]
    return "LATIN" if name == "FULLWIDTH" else "CJK" if name in JAPANESE else name


def dominant_script(token: str) -> tuple[str, bool]:
    """The script most letters of ``token`` have, and whether there are others."""
    seen = Counter(s for s in map(script, token) if s)
    return (max(sorted(seen), key=seen.__getitem__) if seen else "", len(seen) > 1)


WORD = T.StructType(
    [T.StructField("token", T.StringType()), T.StructField("look", T.StringType()), T.StructField("script", T.StringType()), T.StructField("mixed", T.BooleanType())]
)


@functools.lru_cache(1 << 15)
def _word(token: str) -> dict:
    main, mixed = dominant_script(token)
    return {"token": token, "look": look(token), "script": main, "mixed": mixed}


def words(text: str) -> list[dict]:
    """The tokens of a text with their look and script; unseen characters are left out, and every blank parts tokens."""
    shown = "".join(" " if unicodedata.category(c) == "Zs" else c for c in text if _open(c))
    return [_word(t) for t in shown.split(" ")]


@F.pandas_udf(T.ArrayType(WORD))
def _words(text: pd.Series) -> pd.Series:
    return text.map(words)


@F.pandas_udf(T.BooleanType())
def _alike(one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([x == y or alike(x, y) for x, y in zip(one, other)], dtype=bool)


def tokens_of(texts: DataFrame) -> DataFrame:
    """``_field``, ``_text``, ``_pos`` and the parts of ``WORD`` of each token of distinct texts."""
    each = texts.select("_field", "_text", F.posexplode(_words("_text")).alias("_pos", "w"))
    return each.select("_field", "_text", "_pos", "w.*")


def vocabulary(known: DataFrame, corpus: DataFrame) -> DataFrame:
    """``_field``, ``look``, ``into_script``, ``into``, ``sure``: what a token may be replaced by. Tokens of the reference texts
    are sure; for a look that these don't have in a script, the corpus' most frequent token that mixes no scripts is
    taken, of equal ones the largest, so that a look has few rows."""
    key = ["_field", "look", "script"]
    own = tokens_of(known).select(*key, F.col("token").alias("into"), F.lit(True).alias("sure")).distinct()
    seen = corpus.where("NOT mixed AND look <> ''").groupBy(*key, "token").agg(F.count(F.lit(1)).alias("n"))
    frequent = seen.groupBy(*key).agg(F.max(F.struct("n", "token")).alias("m")).select(*key, F.col("m.token").alias("into"), F.lit(False).alias("sure"))
    return own.unionByName(frequent.join(own.select(*key).distinct(), key, "left_anti")).withColumnRenamed("script", "into_script")


def replacements(corpus: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``_field``, ``token``, ``choices`` (script, token, whether it is sure; one for each script) and ``main``, the choice taken
    where nothing else is known.

    A token that mixes scripts has its look-alikes replaced if the result is in the vocabulary: best in the token's
    dominant script. A token in letters of one script only mixes no scripts in itself, so that this condition misses it;
    a rule of its own replaces it by a token of the reference texts, be it in another script or of the same one.
    """
    own = corpus.select("_field", "token", "look", "script", "mixed").distinct()
    met = own.join(vocabulary, ["_field", "look"]).where((F.col("mixed") | F.col("sure")) & _alike("token", "into"))
    best = F.min(F.struct((~F.col("sure")).alias("unsure"), (F.col("into") != F.col("token")).alias("other"), (F.col("into_script") != F.col("script")).alias("far"), "into"))
    by_script = met.groupBy("_field", "token", "into_script").agg(best.alias("b"))
    return by_script.groupBy("_field", "token").agg(
        F.sort_array(F.collect_list(F.struct("into_script", "b.into", "b.unsure"))).alias("choices"), F.min("b").getField("into").alias("main")
    )


def spellings(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``_field``, ``_text``, ``_spellings``: each distinct text with its tokens replaced: first by the main choices, then, for
    each script that a token may be written in, with that script's choices. Texts whose tokens all stay are left out."""
    corpus = cut_lineage(tokens_of(texts))
    found = replacements(corpus, vocabulary(known, corpus))
    parts = corpus.join(found, ["_field", "token"], "left").groupBy("_field", "_text").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "token", "main", "choices"))).alias("parts")
    )

    def spelt(script: Column | None) -> Column:
        def one(p: Column) -> Column:
            usual = F.coalesce(p["main"], p["token"])
            if script is None:
                return usual
            return F.coalesce(F.get(F.filter(p["choices"], lambda c: c["into_script"] == script), F.lit(0))["into"], usual)

        return F.array_join(F.transform("parts", one), " ")

    scripts = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.coalesce(p["choices"]["into_script"], F.array().cast("array<string>")))))
    every = F.array_distinct(F.concat(F.array(spelt(None)), F.transform(scripts, spelt)))
    return parts.select("_field", "_text", every.alias("_spellings")).where((F.size("_spellings") > 1) | (F.get("_spellings", F.lit(0)) != F.col("_text")))


def _known(reference: DataFrame) -> DataFrame:
    whole = reference.where(F.col("text").isNotNull() & F.col("field_name").isNotNull())
    return whole.select(F.col("field_name").alias("_field"), F.col("text").alias("_text")).distinct()


def repair_texts(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``_repaired`` to ``values`` (with columns ``_field`` and ``_text``): the text with unseen characters out, blanks
    plain and its tokens replaced by those of the vocabulary: the spelling that is a ``reference`` text (``field_name``,
    ``text``) of its field, of several the least, or else the first one.

    The vocabulary is that of the reference texts and of the corpus itself (``vocabulary``). Texts, tokens and vocabulary
    meet by joins of distinct values on field and look; there is one way for any number of them. Null texts stay null;
    texts without a field, and empty ones, stay as they are.
    """
    known = _known(reference)
    texts = values.where(F.col("_text").isNotNull() & F.col("_field").isNotNull()).select("_field", "_text").distinct()
    made = spellings(texts.join(known, ["_field", "_text"], "left_anti"), known)
    good = made.select("_field", F.col("_text").alias("_was"), F.explode("_spellings").alias("_text")).join(known, ["_field", "_text"])
    best = good.groupBy("_field", F.col("_was").alias("_text")).agg(F.min("_text").alias("_best"))
    final = made.join(best, ["_field", "_text"], "left").select("_field", "_text", F.coalesce("_best", F.get("_spellings", F.lit(0))).alias("_repaired"))
    return values.join(final, ["_field", "_text"], "left").withColumn("_repaired", F.coalesce("_repaired", "_text"))


def find_lookalikes(values: DataFrame, reference: DataFrame) -> DataFrame:
    """``record_kind``, ``record_id``, ``ref_id`` of each value that looks like a reference text of its field without
    being equal to it.

    ``values`` has ``record_kind``, ``record_id``, ``_field`` and ``_text``. Values equal to a reference text are
    left out before Python sees them; of the others each distinct one is repaired once, and the spellings found are
    looked up among the references. Null values and references never match; repeated rows come out once; if several
    references have one text, each of them comes out.
    """
    names = reference.select(F.col("field_name").alias("_field"), F.col("text").alias("_text"), "ref_id").where(
        F.col("_text").isNotNull() & F.col("_field").isNotNull()
    )
    known = _known(reference)
    other = values.where(F.col("_text").isNotNull()).select("record_kind", "record_id", "_field", "_text").join(known, ["_field", "_text"], "left_anti")
    made = spellings(other.select("_field", "_text").distinct(), known)
    hits = made.select("_field", F.col("_text").alias("_was"), F.explode("_spellings").alias("_text")).join(names, ["_field", "_text"])
    hits = cut_lineage(hits.select("_field", F.col("_was").alias("_text"), "ref_id").distinct())
    return other.join(hits, ["_field", "_text"]).select("record_kind", "record_id", "ref_id").distinct()


def property_values(events: DataFrame, record_id: Column, properties: Column, fields: Iterable[str]) -> DataFrame:
    """The values of some properties of each event as rows for ``find_lookalikes``."""
    each = events.select(
        record_id.alias("record_id"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("_field"), properties[f].alias("_values")) for f in fields])),
    )
    return each.select(
        F.lit("event").alias("record_kind"), "record_id", "_field", F.explode("_values").alias("_text")
    )
