"""Parsers of document formats: sections, blocks and metadata with code-point offsets."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

from spanlight.errors import UsageError

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")


@dataclass
class Parsed:
    """sections: (heading, level, start, end); blocks: (kind, start, end, level)."""

    sections: list[tuple[str, int, int, int]] = field(default_factory=list)
    blocks: list[tuple[str, int, int, int | None]] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)


class Parser(Protocol):
    name: str
    suffixes: tuple[str, ...]
    media_type: str

    def parse(self, content: str) -> Parsed: ...


def lines(content: str) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of every line, without its end; \\n, \\r\\n and \\r end one."""
    for m in _LINE.finditer(content):
        if m.start() == len(content):
            return
        text = m[0].rstrip("\r\n")
        yield text, m.start(), m.start() + len(text)


def _paragraphs(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, None]]:
    start = end = None
    for text, a, b in [*rows, ("", 0, 0)]:
        if text.strip():
            start, end = a if start is None else start, b
        elif start is not None:
            yield "paragraph", start, end, None
            start = None


def _whole(content: str) -> list[tuple[str, int, int, int]]:
    return [("", 0, 0, len(content))] if content else []


class PlainText:
    name, media_type = "plaintext@1", "text/plain"
    suffixes = (".txt", ".text", ".log", ".rst", ".org")

    def parse(self, content: str) -> Parsed:
        return Parsed(_whole(content), list(_paragraphs(list(lines(content)))))


class SourceCode:
    name, media_type = "source@1", "text/x-source"
    suffixes = tuple(f".{s}" for s in "py js ts tsx jsx go rs java kt c h cpp hpp cs rb sh sql toml yaml yml ini cfg".split())

    def parse(self, content: str) -> Parsed:
        return Parsed(_whole(content), [("code", 0, len(content), None)] if content else [])


class Markdown:
    name, media_type = "markdown@1", "text/markdown"
    suffixes = (".md", ".markdown", ".mdown", ".mkd")
    _HEADING = re.compile(r"(#{1,6})(?: |$)")
    _ITEM = re.compile(r"[-*+] |\d+\. .")

    def parse(self, content: str) -> Parsed:
        blocks = self._blocks(list(lines(content)))
        heads = [(content[a:b].strip().lstrip("#").strip(), level, a) for kind, a, b, level in blocks if kind == "heading"]
        sections = _whole(content[: heads[0][2]]) if heads else _whole(content)
        for i, (title, level, at) in enumerate(heads):
            sections.append((title, level, at, next((b for _, n, b in heads[i + 1 :] if n <= level), len(content))))
        return Parsed(sections, blocks, self._metadata(content, blocks, heads))

    def _blocks(self, rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int | None]]:
        out: list[tuple[str, int, int, int | None]] = []
        text: list[tuple[str, int, int]] = []

        def close() -> None:
            if text:
                out.append(("paragraph", text[0][1], text[-1][2], None))
                text.clear()

        i = 0
        if rows and rows[0][0].strip() == "---":
            end = next((n for n, r in enumerate(rows[1:], 1) if r[0].strip() in ("---", "...")), None)
            if end is not None:
                out.append(("front_matter", rows[0][1], rows[end][2], None))
                i = end + 1
        while i < len(rows):
            line, a, b = rows[i]
            bare = line.strip()
            i += 1
            if bare.startswith(("```", "~~~")):
                close()
                end = next((n for n in range(i, len(rows)) if rows[n][0].strip().startswith(bare[:3])), len(rows) - 1)
                i = end + 1
                out.append(("code", a, rows[end][2], None))
            elif not bare:
                close()
            elif m := self._HEADING.match(bare):
                close()
                out.append(("heading", a, b, len(m[1])))
            elif bare[0] == ">":
                close()
                out.append(("quote", a, b, None))
            elif self._ITEM.match(bare):
                close()
                out.append(("list_item", a, b, (len(line) - len(line.lstrip())) // 2))
            else:
                text.append(rows[i - 1])
        close()
        return out

    @staticmethod
    def _metadata(content: str, blocks: list, heads: list) -> dict[str, str]:
        out: dict[str, str] = {}
        for kind, a, b, _ in blocks:
            if kind == "front_matter":
                for line in content[a:b].splitlines()[1:-1]:
                    key, colon, value = line.partition(":")
                    if colon and key.strip() and not key.startswith("-"):
                        out.setdefault(key.strip(), value.strip())
        if "title" not in out and (first := next((t for t, level, _ in heads if level == 1), None)) is not None:
            out["title"] = first
        return out


class Json:
    """One value a file. String leaves and keys are fields where they occur; each top-level key starts a section."""

    name, media_type = "json@1", "application/json"
    suffixes = (".json", ".jsonl", ".ndjson")

    def parse(self, content: str) -> Parsed:
        try:
            data = json.loads(content)
        except json.JSONDecodeError as e:
            raise ValueError(f"not one JSON value: {e}") from e
        blocks, at = [], 0
        for s in filter(None, self._strings(data)):
            for form in (json.dumps(s, ensure_ascii=False), json.dumps(s)):
                if (found := content.find(form, at)) >= 0:
                    blocks.append(("field", found, found + len(form), None))
                    at = found + 1
                    break
        marks: list[tuple[int, str]] = []
        if isinstance(data, dict):
            marks = sorted((i, k) for k in data if (i := content.find(json.dumps(k, ensure_ascii=False))) >= 0)
        ends = [i for i, _ in marks[1:]] + [len(content)]
        sections = [(k, 1, i, e) for (i, k), e in zip(marks, ends)] or _whole(content)
        meta = {k: str(data[k]) for k in ("title", "name", "id") if isinstance(data, dict) and isinstance(data.get(k), (str, int, float))}
        return Parsed(sections, blocks, meta)

    def _strings(self, data) -> Iterator[str]:
        if isinstance(data, dict):
            for k, v in data.items():
                yield k
                yield from self._strings(v)
        elif isinstance(data, list):
            for v in data:
                yield from self._strings(v)
        elif isinstance(data, str):
            yield data


_by_suffix: dict[str, Parser] = {}


def register_parser(parser: Parser, replace: bool = False) -> None:
    """Parse files of the parser's suffixes with it; a suffix that another has is refused unless replaced."""
    for s in parser.suffixes:
        held = _by_suffix.get(s.lower())
        if held is not None and held.name != parser.name and not replace:
            raise UsageError(f"{s} belongs to {held.name}; pass replace=True to take it")
    _by_suffix.update({s.lower(): parser for s in parser.suffixes})


def parser_for(path: str) -> Parser | None:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return _by_suffix.get(name[dot:].lower()) if dot > 0 else None


def known_parsers() -> list[str]:
    return sorted({p.name for p in _by_suffix.values()})


def registered_suffixes() -> list[str]:
    return sorted(_by_suffix)


def registry() -> dict[str, Parser]:
    """A copy to ship to executors."""
    return dict(_by_suffix)


for _p in (PlainText(), SourceCode(), Markdown(), Json()):
    register_parser(_p)
