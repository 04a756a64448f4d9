"""Tokens of source code as rows of (value, type), and the keys that term statistics count."""

from __future__ import annotations

import keyword
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kindred.session import ship

#: Reserved words of each language.
KEYWORDS = {
    "python": frozenset(keyword.kwlist) | {"self", "cls", "match", "case"},
    "javascript": frozenset("async await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof undefined var void while with yield".split()),
    "java": frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough false for func go goto if import interface map nil package range return select struct switch true type var".split()),
    "rust": frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()),
    "c": frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while".split()),
    "csharp": frozenset("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using var virtual void volatile while".split()),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] | frozenset("abstract any as asserts boolean constructor declare enum get implements infer interface is keyof module namespace never number object private protected public readonly require set string symbol type unknown".split())
KEYWORDS["cpp"] = KEYWORDS["c"] | frozenset("bool catch class constexpr delete explicit export false friend mutable namespace new nullptr operator override private protected public template this throw true try typename using virtual".split())

_SCAN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/|\#[^\n]*)
      | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)
      | (?P<number>-?(?:0[xX][0-9A-Fa-f]+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?))
      | (?P<name>[A-Za-z_$][A-Za-z0-9_$]*)
      | (?P<operator>===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|->|::|:=|[+\-*/%=<>!&|^~?:.@])
      | (?P<punctuation>[(){}\[\];,])""",
    re.X | re.S,
)
#: The same without groups.
_FIND = re.compile(re.sub(r"\(\?P<\w+>", "(?:", _SCAN.pattern), re.X | re.S)
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]+")
_HUMP = re.compile(r"(?<=.)(?=[A-Z][a-z])")


def split_identifier(name: str) -> list[str]:
    return name.split("_") if "_" in name else _HUMP.split(name)


def tokenize(code: str | None, language: str = "typescript") -> list[tuple[str, str]]:
    """(value, type) of each token; strings and numbers become placeholders, comments their words, names their parts."""
    reserved = KEYWORDS.get(language, KEYWORDS["typescript"])
    out: list[tuple[str, str]] = []
    for m in _SCAN.finditer(code or ""):
        kind, value = m.lastgroup, m[0]
        if kind == "comment":
            out += [(w.lower(), "comment") for w in _WORD.findall(value)]
        elif kind == "string":
            if 2 < len(value) < 100:
                out.append(("STRING_LITERAL", "string"))
        elif kind == "number":
            out.append(("NUMBER", "number"))
        elif kind == "name":
            if value in reserved:
                out.append((value, "keyword"))
            else:
                out += [(p.lower(), "identifier") for p in split_identifier(value) if len(p) > 1]
        else:
            out.append((value, kind))
    return out


def find_tokens(code: str) -> list[str]:
    """The stretches of text that ``tokenize`` makes tokens of; each alone gives the same tokens."""
    return _FIND.findall(code)


def code_tokens(code: Column, language: Column | None = None) -> Column:
    """ARRAY<STRUCT<value, type>> of each text."""

    @F.pandas_udf("array<struct<value:string,type:string>>")
    def tokens(text: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([[{"value": v, "type": t} for v, t in tokenize(c, x or "typescript")] for c, x in zip(text, lang, strict=True)])

    return tokens(code, F.lit("typescript") if language is None else language)


def token_keys(tokens: Column) -> Column:
    """Term keys ``type:value``."""
    return F.transform(tokens, lambda t: F.concat_ws(":", t["type"], t["value"]))


def token_rows(blocks: DataFrame) -> DataFrame:
    """(block_id, keys) of (block_id, content, language)."""
    ship(blocks.sparkSession)
    return blocks.select("block_id", token_keys(code_tokens(F.col("content"), F.col("language"))).alias("keys"))
