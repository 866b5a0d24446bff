"""Message tokeniser with protected spans, character offsets, and the string of proper words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of spans that stay whole. Emoticons come first and also match within words, dots in them
# match any character, and a bare colon counts as one.
EMOTICONS = (
    r":\)|:\(|:-\)|>:]|:o\)|:3|:c\)|:>|=]|8\)|=\)|:}|:^\)|>:D\)|:-D|:D|8-D|8D|x-D|xD|X-D|XD|=-D|=D|=-3|=3\)|8-\)|:-\)\)|:\)\)|>-\[|:-\(|:\(|:-c|:c|:-<|:<|:-\[|:\[|:{|>.>|<.<|>.<|:-\|\||"
    r"D:<|D:|D8|D;|D=|DX|v.v|D-':|>;\]|;-\)|;\)|\*-\)|\*\)|;-\]|;\]|;D|;^\)|>:P|:-P|:P|X-P|x-p|xp|XP|:-p|:p|=p|:-b|:b|>:o|>:O|:-O|:O|:0|o_O|o_0|o.O|8-0|>:\\|>:/|:-/|:-.|:/|:\\|=/|=\\|"
    r":S|:\||:-\||>:X|:-X|:X|:-#|:#|:$|O:-\)|0:-3|0:3|O:-\)|O:\)|0;^\)|>:\)|>;\)|>:-\)|:'-\(|:'\(|:'-\)|:'\)|;\)\)|;;\)|<3|8-}|>:D<|=\)\)|=\(\(|x\(|X\(|:-\*|:\*|:\">|~X\(|:-?"
)
MARKS = "['\"“.?!,:;]"
ENTITY = "&(?:amp|lt|gt|quot);"
DOMAINS = r"(?:com|co\.uk|org|net|info|ca)"
URL = rf"\b(?:(?:https?://|www\.)|[a-z0-9.-]+?\.{DOMAINS}(?=[/ \W]))[^ \t\r\n<>]*?(?=(?:(?:{MARKS}|{ENTITY})+?)?(?:\.\.+|[<>]|\s|$))"
CLOCK = r"\d+:\d+h{0,1}"
DECIMAL = r"\d+\.\d+"
GROUPED = r"(?:\d+,)+?\d{3}(?=(?:[^,]|$))"
EDGE = rf"(?:\s|[“\"?!,:;]|{ENTITY})"
ABBREVIATION = rf"(?:(?:[A-Za-z]\.){{2,}}(?={EDGE})|(?:[A-Za-z]\.)+[A-Za-z](?={EDGE}))"
DASHES = "(?:--+|―)"
NOTES = "[♫]+"
APOSTROPHE = r"\S+'\S+"
QUOTES = "'\"“”‘’<>«»{}()\\[\\]"
#: Blanks as ``str.split`` knows them, for the same cut in patterns.
BLANKS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Words that never count as language, and shapes that no proper word has.
NOT_LANGUAGE = {"rt", "retweet", "via", "(", ")", "-", "/via", "/", "//", "=", "%", "|"}

_PROTECTED = re.compile("|".join(f"(?:{p})" for p in (EMOTICONS, URL, ENTITY, CLOCK, DECIMAL, GROUPED, f"{MARKS}+", ABBREVIATION, DASHES, NOTES, APOSTROPHE)))
_IMPROPER = re.compile("|".join(f"(?:{p})" for p in (EMOTICONS, URL, DECIMAL, GROUPED, f"{MARKS}+", DASHES, CLOCK, r"^\d+", "^.$", r"[()][+-]*\d+[()]*")))
_OPENING = re.compile(rf"(^|\s)([{QUOTES}]+)([a-zA-Z0-9])")
_CLOSING = re.compile(rf"([a-zA-Z0-9])([{QUOTES}]+)(\s|$)")
_GENITIVE = re.compile(r"^(\S+)('s)$", re.DOTALL)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def tokenise(text: str) -> list[tuple[str, int | None]]:
    """(token, offset) of a message; offsets are into its text with white space squeezed, None for a token that holds a
    blank set in at a quote and so doesn't stand in the text.

    Quotes and brackets at the edges of words are set apart. Protected spans stay whole; what lies between is split at
    white space; a closing 's is split off its word.
    """
    plain = squeeze(text)
    apart = _CLOSING.sub(r"\1 \2\3", _OPENING.sub(r"\1\2 \3", plain))
    pieces, end = [], 0
    for span in _PROTECTED.finditer(apart):
        pieces += apart[end : span.start()].split()
        pieces.append(span[0])
        end = span.end()
    pieces += apart[end:].split()
    out, at = [], 0
    for piece in pieces:
        parts = _GENITIVE.match(piece)
        for token in parts.groups() if parts else (piece,):
            if not token.strip():
                continue
            found = plain.find(token, at)
            out.append((token, found if found >= 0 else None))
            at = found + len(token) if found >= 0 else at
    return out


def proper_words(tokens: list[str]) -> str:
    """The lower-cased words that may tell the language, by single blanks."""
    return " ".join(t.lower() for t in tokens if t[0] not in "#@" and t.lower() not in NOT_LANGUAGE and not _IMPROPER.search(t))


def _analyse(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [tokenise(t) if t is not None else None for t in part]
        yield pd.DataFrame({
            "tokens": pd.Series([None if f is None else [{"token": t, "pos": p} for t, p in f] for f in found], dtype=object),
            "tok_lang": pd.Series([None if f is None else proper_words([t for t, _ in f]) for f in found], dtype=object),
        })


def analyse(text: Column | str) -> Column:
    """struct<tokens array<struct<token, pos>>, tok_lang>; both null for a null text, empty for an empty one."""
    run = F.pandas_udf(_analyse, "tokens array<struct<token:string,pos:int>>, tok_lang string", F.PandasUDFType.SCALAR_ITER)
    return run(F.col(text) if isinstance(text, str) else text)


def _language_words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([None if ts is None else proper_words([t for t in ts if t]) for ts in part], dtype=object)


def language_words(tokens: Column) -> Column:
    """``proper_words`` of a column of token arrays; null for null arrays."""
    return F.pandas_udf(_language_words, "string", F.PandasUDFType.SCALAR_ITER)(tokens)
