"""Texts and labels. Classes of characters are spelt out, as \\w and \\s are ASCII in some engines."""

from __future__ import annotations

import functools
import hashlib
import operator
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, letters and digits, and what a safe text has none of.
SPACES = r"[\t-\r\x1c- \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ALNUM = r"[\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}_]+"
CONTROLS = r"[\p{Cc}\p{Cf}&&[^\n\t]]"
#: Thresholds of the quality signals.
LEAST_ALNUM, LEAST_RATIO, LEAST_MEAN, LEAST_POINT = 12, 0.5, 0.8, 0.6
#: Secrets and local paths in public text; where a pattern begins with ^, only the text's beginning counts.
SECRET_ASSIGNMENT = r"(?i)(?:api[_-]?key|password|secret|token|bearer)\s*[:=]\s*\S+"
SECRET_TOKEN = r"(?i)\b(?:sk|ghp|github_pat)-?[A-Za-z0-9_]{8,}\b"
URI_CREDENTIAL = r"(?i)^[a-z][a-z0-9+.-]*://[^/@:]+:[^/@]+@"
WINDOWS_PATH = r"^[A-Za-z]:[\\/]"
PATH_STARTS, PATH_PARTS = ("/", "~/", "~\\", "\\\\"), ("file://", "/home/", "/users/", "\\users\\")
#: The closed set of operating states.
STATES = ("normal", "baseline", "teste", "acelerando", "motor_desligado")
#: Letters with accents and their plain forms, for engines without Unicode decomposition.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def count_of(text: Column, pattern: str) -> Column:
    """Characters of a class; whole runs go at once, which is many times faster than single characters."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def measures(text: Column, confidences: Column | None = None) -> Column:
    """struct of character counts, words, share of letters and digits, and quality signals in a fixed order. `confidences` (array) marks recognised text."""
    characters = F.length(text)
    counts = F.struct(
        characters.alias("characters"), (characters - count_of(text, SPACES)).alias("solid"), count_of(text, ALNUM).alias("alphanumeric"), F.regexp_count(text, F.lit(WORD)).alias("words"),
        count_of(text, "\uFFFD").alias("replaced"), count_of(text, CONTROLS).alias("controls"), *([] if confidences is None else [confidences.alias("confidences")]),
    )

    def judged(m: Column) -> Column:
        share = F.round(m["alphanumeric"] / F.nullif(m["solid"].cast("double"), F.lit(0.0)), 6)
        signals = [F.when(m["solid"] == 0, "text.empty"), F.when((m["solid"] > 0) & (m["alphanumeric"] < LEAST_ALNUM), "text.too_short"), F.when(share < LEAST_RATIO, "text.low_alphanumeric_ratio"), F.when(m["replaced"] > 0, "text.replacement_characters"), F.when(m["controls"] > 0, "text.control_characters")]
        if confidences is not None:
            found = m["confidences"]
            mean = F.round(F.aggregate(found, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(found), F.lit(0)), 6)
            signals += [F.when(F.size(found) == 0, "ocr.confidence_unavailable"), F.when(mean < LEAST_MEAN, "ocr.low_mean_confidence"), F.when(F.round(F.array_min(found), 6) < LEAST_POINT, "ocr.low_minimum_confidence")]
        return F.struct(*(m[c].alias(c) for c in ("characters", "solid", "alphanumeric", "words")), share.alias("share"), m["replaced"].alias("replaced"), m["controls"].alias("controls"), F.array_compact(F.array(*signals)).alias("signals"))

    # The array of one element holds the counts, so that each is taken once, whatever is made of it.
    return F.element_at(F.transform(F.array(counts), judged), 1)


def normalize(text: Column) -> Column:
    """Line ends as \\n, white space off both ends."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), f"^{SPACES}+|{SPACES}+$", "")


def clean_noise(text: Column) -> Column:
    """Technical noise: NUL, BS, DEL go; VT and FF break lines; blanks at line ends go; at most three line ends in a row; none at the edges."""
    lines = F.regexp_replace(F.translate(F.regexp_replace(text, "\r\n?", "\n"), "\x00\x08\x7f", ""), "[\x0b\x0c]", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, "[ \t]+(?=\n|$)", ""), "\n{4,}", "\n\n\n"), "^\n+|\n+$", "")


def unsafe(text: Column) -> Column:
    """Controls other than tab and line ends, format characters, surrogates, noncharacters."""
    return F.translate(text, "\t\n\r", "").rlike(r"[\p{Cc}\p{Cf}\p{Cs}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]")


def secrets(text: Column) -> Column:
    """Which kinds of secrets, credentials or machine paths a text shows."""
    small = F.lower(text)
    local = functools.reduce(operator.or_, [text.rlike(WINDOWS_PATH), *(text.startswith(p) for p in PATH_STARTS), *(small.contains(p) for p in PATH_PARTS)])
    return F.array_compact(F.array(F.when(text.rlike(SECRET_ASSIGNMENT), "assignment"), F.when(text.rlike(SECRET_TOKEN), "token"), F.when(text.rlike(URI_CREDENTIAL), "uri_credential"), F.when(local, "machine_path")))


def plain(text: Column) -> Column:
    """Small letters without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def label_key(raw: str) -> str:
    """Compatibility form, small letters (also of ß and its kind), separators - _ / as blanks, white space as single blanks."""
    folded = " ".join(unicodedata.normalize("NFKC", raw).split()).casefold()
    return " ".join(folded.translate(str.maketrans("-_/", "   ")).split())


@F.pandas_udf(T.StringType())
def normalized_label(raw: pd.Series) -> pd.Series:
    """label_key for any Unicode; Spark has neither compatibility forms nor case folding."""
    return raw.map(label_key, na_action="ignore")


def normalized_ascii_label(raw: Column) -> Column:
    """The same for ASCII labels, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(raw), r"[\s\-_/]+", " "))


def slug(label: Column) -> Column:
    """Blank as -, a-z and 0-9 kept, every other byte of UTF-8 as %XX."""
    return F.array_join(F.transform(F.split(label, ""), lambda c: F.when(c == " ", "-").when(c.rlike("^[a-z0-9]$"), c).when(c == "", "").otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")


def operating_state(value: Column) -> Column:
    """The state that a whole value names, or null."""
    key = F.translate(plain(value), "-", "_")
    return F.when(key.isin(*STATES), key)


@F.pandas_udf(T.StringType())
def question(value: pd.Series) -> pd.Series:
    """NFC, single blanks, 3 to 500 characters; else null."""

    def one(text: str) -> str | None:
        made = " ".join(unicodedata.normalize("NFC", text).split())
        return made if 3 <= len(made) <= 500 else None

    return value.map(one, na_action="ignore")


def document_id(filename: Column) -> Column:
    """Identity of a document from its file's name in small letters; null for what is no plain PDF name."""
    name = F.lower(F.trim(filename))
    return F.when(name.rlike(r"^[a-z0-9][a-z0-9._ -]{0,250}\.pdf$"), F.concat(F.lit("doc_"), F.sha2(name, 256)))


def hash_vector(text: str, dimension: int, version: str) -> list[float]:
    """A deterministic unit vector: 16-bit numbers of SHAKE-256 over version, NUL and text, spread over -1 to 1. Says nothing about meaning."""
    noise = np.frombuffer(hashlib.shake_256(f"{version}\0{text}".encode()).digest(2 * dimension), ">u2") / 32767.5 - 1.0
    length = np.linalg.norm(noise)
    return (noise / length if length else np.eye(dimension)[0]).tolist()


def hash_embedding(dimension: int = 32, version: str = "hash.v1"):
    """A pandas UDF that embeds texts by hash_vector."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: hash_vector(t, dimension, version), na_action="ignore")

    return embed
