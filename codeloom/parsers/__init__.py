"""Parsers of five languages, a registry for others, and the one Spark operator that runs them over a table of sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.functions.fixed import LANGUAGE_OF
from codeloom.parsers.declarations import symbols
from codeloom.parsers.imports import imports
from codeloom.parsers.masking import HIDDEN, Outline
from codeloom.parsers.skeleton import skeleton

SYMBOL = "name string, kind string, signature string, parent string, visibility string, exported boolean, start_line int, end_line int, start_byte long, end_byte long"
IMPORT = "raw string, imported_symbol string, type string, candidates array<string>, mode string, fallback string"
PARSED = f"path string, symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ', ')}>>, imports array<struct<{IMPORT.replace(' ', ':').replace(',:', ', ')}>>, has_errors boolean, skeleton string"
_SYMBOL_NAMES, _IMPORT_NAMES = ([x.split()[0] for x in s.split(", ")] for s in (SYMBOL, IMPORT))
_SYMBOL_TYPE = pa.struct([(n, {"exported": pa.bool_(), "start_line": pa.int32(), "end_line": pa.int32(), "start_byte": pa.int64(), "end_byte": pa.int64()}.get(n, pa.string())) for n in _SYMBOL_NAMES])
_IMPORT_TYPE = pa.struct([(n, pa.list_(pa.string()) if n == "candidates" else pa.string()) for n in _IMPORT_NAMES])
_SCHEMA = pa.schema([("path", pa.string()), ("symbols", pa.list_(_SYMBOL_TYPE)), ("imports", pa.list_(_IMPORT_TYPE)), ("has_errors", pa.bool_()), ("skeleton", pa.string())])


#: By language: (path, text, go module, workspace packages) to a row of PARSED; what a parser leaves out is empty.
Parser = Callable[[str, str, str | None, dict | None], dict]
PARSERS: dict[str, Parser] = {}


def register(language: str, endings: list[str], parser: Parser) -> None:
    """Adds a language, or replaces the parser of one. Sources with these endings are found from then on."""
    PARSERS[language] = parser
    LANGUAGE_OF.update({e.lower().lstrip("."): language for e in endings})


def parse(path: str, text: str, language: str, go_module: str | None = None, packages: dict | None = None) -> dict:
    """A row of PARSED, by the parser of the language."""
    return _empty(path, text) | PARSERS[language](path, text, go_module, packages)


def _empty(path: str, text: str) -> dict:
    return {"path": path, "symbols": [], "imports": [], "has_errors": False, "skeleton": text}


def _outlined(language: str) -> Parser:
    return lambda path, text, go_module, packages: _parse(path, text, language, go_module, packages)


def _parse(path: str, text: str, language: str, go_module: str | None, packages: dict | None) -> dict:
    o = Outline(text, language)
    found = [(*s[:6], o.line(s[6]), o.line(max(s[7] - 1, s[6])), o.byte(s[6]), o.byte(s[7])) for s in symbols(o)]
    return {
        "path": path,
        "symbols": [dict(zip(_SYMBOL_NAMES, s)) for s in found],
        "imports": [dict(zip(_IMPORT_NAMES, i)) for i in imports(o, path, go_module, packages)],
        "has_errors": not o.balanced,
        "skeleton": skeleton(o),
    }


for _language in HIDDEN:
    register(_language, [], _outlined(_language))


def parse_sources(sources: DataFrame, go_module: str | None = None, packages: dict | None = None) -> DataFrame:
    """sources: path, language, content (binary). One row for each source in a known language; bytes that aren't UTF-8
    are replaced. No shuffle; a task parses its own rows. Null content counts as empty."""

    known = dict(PARSERS)  # tasks get the parsers that are registered now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, lang, (c or b"").decode("utf-8", "replace")) for p, lang, c in zip(*(batch[c].to_pylist() for c in ("path", "language", "content"))) if lang in known]
            out = [_empty(p, text) | known[lang](p, text, go_module, packages) for p, lang, text in rows]
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return sources.select("path", "language", "content").mapInArrow(run, PARSED)
