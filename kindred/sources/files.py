"""Source files as rows, and the table function that cuts them into blocks."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.config import ParserConfig
from kindred.functions import scalars as S
from kindred.session import ship


def read_files(spark: SparkSession, root: str, config: ParserConfig | None = None) -> DataFrame:
    """(path, content, bytes, language) of every readable file below ``root`` that the globs admit."""
    config = config or ParserConfig()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    rows = raw.select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("bytes"))
    return rows.where(S.matches_globs(F.col("path"), config.include, config.exclude)).withColumn("language", S.language_of(F.col("path"), config.default_language))


def from_text(spark: SparkSession, code: str, path: str = "query.ts", language: str | None = None) -> DataFrame:
    """A one-row file table for a snippet."""
    df = spark.createDataFrame([(path, code, len(code.encode()), language)], "path string, content string, bytes long, language string")
    return df.withColumn("language", F.coalesce("language", S.language_of(F.col("path"), "typescript")))


@dataclass(frozen=True)
class Grammar:
    """How declarations that open a block read in a language, after their modifiers.

    ``keywords`` open a block of a kind and are followed by its name. ``binders`` give a name to a function value. ``bodies`` are the
    words after the name on which the kind of a ``type`` declaration depends. ``callables`` says what a name with a parameter
    list needs to be a block without a keyword: "body" (a brace or a type after the list), "modifier", or "type" (one before the name,
    and a brace).
    """

    keywords: dict[str, str]
    modifiers: frozenset[str] = frozenset()
    binders: frozenset[str] = frozenset()
    bodies: dict[str, str] = field(default_factory=dict)
    callables: str = ""


def _grammar(keywords: str, modifiers: str = "", binders: str = "", bodies: str = "", callables: str = "") -> Grammar:
    table = lambda text: dict(pair.split(":") for pair in text.split())
    return Grammar(table(keywords), frozenset(modifiers.split()), frozenset(binders.split()), table(bodies), callables)


_SCRIPT = _grammar("function:function class:class interface:interface type:type", "export default declare abstract async public private protected static readonly override get set", "const let var", callables="body")
_MANAGED = _grammar("class:class interface:interface", "public private protected internal static final abstract sealed virtual override synchronized native async partial", callables="modifier")
_NATIVE = _grammar("class:class struct:struct", "static inline extern const constexpr virtual explicit typedef", callables="type")
GRAMMARS: dict[str, Grammar] = {
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "python": _grammar("def:function class:class", "async"),
    "java": _MANAGED,
    "csharp": _MANAGED,
    "go": _grammar("func:function type:", bodies="struct:struct interface:interface"),
    "rust": _grammar("fn:function struct:struct trait:trait impl:impl", "pub async unsafe const extern default"),
    "c": _NATIVE,
    "cpp": _NATIVE,
}
_DEFAULT = _grammar("function:function class:class", "export default async abstract")
#: Words that are followed by brackets but name nothing.
_CONTROL = frozenset("if else for foreach while do switch catch return throw new await yield sizeof typeof using lock fixed synchronized with when match super this function".split())
_PART = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|=>|->|::|\S")
_CLOSING = {"(": ")", "<": ">", "[": "]"}
#: What braces may not be counted in: strings and comments, by the marks that begin a comment.
_QUOTED = r"""\"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""
_HIDDEN = {
    "python": re.compile(r"""\"\"\".*?\"\"\"|\'\'\'.*?\'\'\'|#[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S),
    "rust": re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\[^\n]+?|[^'\\\n])'""", re.S),
}
_HIDDEN_ELSE = re.compile(rf"//[^\n]*|/\*.*?\*/|{_QUOTED}", re.S)


def code_lines(source: str, language: str) -> list[str]:
    """The source's lines with strings and comments blanked out, so that columns and line numbers stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return _HIDDEN.get(language, _HIDDEN_ELSE).sub(blank, source).split("\n")


def _is_name(part: str) -> bool:
    return part[0].isalpha() or part[0] in "_$"


def _after_group(parts: list[str], at: int) -> int:
    """The place after the bracket group that begins at ``at``, or ``at`` itself; the line's end where it isn't closed."""
    if at >= len(parts) or parts[at] not in _CLOSING:
        return at
    opens, closes, depth = parts[at], _CLOSING[parts[at]], 0
    for i in range(at, len(parts)):
        depth += (parts[i] == opens) - (parts[i] == closes)
        if not depth:
            return i + 1
    return len(parts)


def opening(line: str, grammar: Grammar) -> tuple[str | None, str] | None:
    """(name, kind) of the block that a line of code opens, if it opens one."""
    parts = _PART.findall(line)
    at = 0
    while at < len(parts) and parts[at] in grammar.modifiers:
        at = _after_group(parts, at + 1) if at + 1 < len(parts) and parts[at + 1] == "(" and grammar.callables == "" else at + 1
    marked, parts = at > 0, parts[at:]
    if not parts:
        return None
    if parts[0] in grammar.keywords:
        at = _after_group(parts, 1 + (parts[1:2] == ["*"]))
        name = parts[at] if at < len(parts) and _is_name(parts[at]) else None
        kind = grammar.keywords[parts[0]] or grammar.bodies.get(parts[at + 1] if at + 1 < len(parts) else "", "")
        return (name, kind) if kind else None
    if not _is_name(parts[0]):
        return None
    bound = parts[0] in grammar.binders
    if grammar.binders and (bound or parts[1:2] in (["="], [":"])):
        sign = next((i for i, p in enumerate(parts) if p == "=" or (p == ":" and not bound)), None)
        value = parts[sign + 1 :] if sign else []
        value = value[1:] if value[:1] == ["async"] else value
        if value and (value[0] == "function" or (value[0] in "(<" and (bound or "=>" in value)) or value[1:2] == ["=>"]):
            return parts[1 if bound else 0], "function"
        return None
    if "(" not in parts or not grammar.callables:
        return None
    bracket = parts.index("(")
    name, before = parts[bracket - 1], parts[: bracket - 1]
    if not bracket or not _is_name(name) or name in _CONTROL or parts[0] in _CONTROL:
        return None
    after = parts[_after_group(parts, bracket) :]
    if grammar.callables == "body" and not before and after[:1] in (["{"], [":"]):
        return name, "method"
    if grammar.callables == "modifier" and marked and after[:1] != [";"]:
        return name, "method"
    if grammar.callables == "type" and before and "{" in after and all(_is_name(p) or p in ("*", "&", "::", "<", ">", ",") for p in before):
        return name, "function"
    return None


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def line_blocks(source: str, language: str, min_chars: int = 20) -> Iterator[dict]:
    """Outermost blocks by their opening lines: Python's by indentation, other languages' by counting braces outside strings and comments.

    A block that opens and closes on its line stands alone; any other needs two lines. What is nested in a block is
    part of it.
    """
    lines, code, grammar = source.split("\n"), code_lines(source, language), GRAMMARS.get(language, _DEFAULT)
    at = 0
    while at < len(lines):
        opened = opening(code[at], grammar)
        if not opened:
            at += 1
            continue
        first = at
        if language == "python":
            end = first + 1
            while end < len(lines) and (not code[end].strip() or _indent(code[end]) > _indent(code[first])):
                end += 1
            at = end
        else:
            depth = code[first].count("{") - code[first].count("}")
            end = first + 1
            alone = depth <= 0 and "{" in code[first] and "}" in code[first]
            while not alone and end < len(lines):
                depth += code[end].count("{") - code[end].count("}")
                end += 1
                if depth <= 0:
                    break
            at = end
            if not alone and end - first < 2:
                continue
        if end - first < 2 and language == "python" and end == len(lines):
            continue
        content = "\n".join(lines[first:end])
        if len(content.strip()) >= min_chars:
            yield {"start_line": first + 1, "end_line": end, "content": content, "block_type": opened[1], "name": opened[0] or f"anonymous_{first + 1}"}


def syntax_blocks(source: str, language: str, min_chars: int = 20) -> Iterator[dict]:
    """Outermost functions and classes by Python's own parser, decorators included; other languages by ``line_blocks``."""
    if language != "python":
        yield from line_blocks(source, language, min_chars)
        return
    lines = source.split("\n")
    for node in ast.parse(source).body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            content = "\n".join(lines[first - 1 : node.end_lineno])
            if len(content.strip()) >= min_chars:
                kind = "class" if isinstance(node, ast.ClassDef) and not node.decorator_list else "function"
                yield {"start_line": first, "end_line": node.end_lineno, "content": content, "block_type": kind, "name": node.name}


#: Parsers by name; a further one is a function (source, language, min_chars) -> block rows.
PARSERS: dict[str, Callable[[str, str, int], Iterator[dict]]] = {"lines": line_blocks, "syntax": syntax_blocks}

_BLOCKS = "path string, language string, start_line int, end_line int, content string, block_type string, name string, error string"


def parse_files(files: DataFrame, parser: str | Callable = "lines", config: ParserConfig | None = None) -> DataFrame:
    """Block rows of (path, content, language), with one row of ``error`` for each file that can't be parsed."""
    ship(files.sparkSession)
    config = config or ParserConfig()
    parse = PARSERS[parser] if isinstance(parser, str) else parser

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content, language in zip(frame["path"], frame["content"], frame["language"], strict=True):
                head = {"path": path, "language": language}
                try:
                    for block in parse(content or "", language or config.default_language, config.min_chars):
                        out.append(head | block | {"error": None})
                except (SyntaxError, ValueError) as e:
                    out.append(head | {"error": f"{type(e).__name__}: {e}"})
            table = pd.DataFrame(out, columns=[c.split()[0] for c in _BLOCKS.split(", ")], dtype=object)
            yield table.where(table.notna(), None).astype({"start_line": "Int32", "end_line": "Int32"})

    return files.select("path", "content", "language").mapInPandas(run, _BLOCKS)


def block_rows(parsed: DataFrame, min_tokens: int = 0) -> DataFrame:
    """Full block rows: id, normalised content, hash and token count."""
    rows = parsed.where("error is null").withColumn("normalized", S.normalize_code(F.col("content")))
    rows = rows.select(
        S.block_id(F.col("path"), F.col("start_line"), F.col("end_line")).alias("block_id"), F.col("path").alias("file_path"), "start_line", "end_line", "content", "normalized", "language", "block_type", "name",
        S.content_hash(F.col("normalized")).alias("content_hash"), S.token_count(F.col("normalized")).alias("token_count"), F.current_timestamp().alias("indexed_at"),
    )
    return rows.where(F.col("token_count") >= min_tokens)


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("path", "language", "error")


def changed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger (path, content_hash) lacks or has with another hash."""
    return files.withColumn("content_hash", F.sha2("content", 256)).join(ledger.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The scan ledger, empty where none has been written."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], "path string, content_hash string, scanned_at timestamp, block_count long")
