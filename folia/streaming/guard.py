"""Model text that comes in chunks: JSON in it is held until it is whole and repaired; all else goes out at once."""

from __future__ import annotations

import json
import re

from ..functions.python_side import repair_json

_FENCE = "```"
_JSON_NAMES = ("", "json", "jsonc", "json5")  # fixed values
_MARKS = re.compile(r'\\.|["{}\[\]]', re.S)
_OPENS = re.compile(r'\{|\[\s*(?:$|[{\["])')


class Guard:
    """A fold over chunks. What is held between chunks: `line`, the end of the text that is still without its newline
    and may open or close something; `region`, the whole lines of an open one; `kind`, what is open: "" nothing,
    "json" a fence whose body may be JSON, "code" another fence, "raw" JSON without a fence.

    Text that comes out depends on the whole text alone, not on where it was cut.
    """

    FIELDS = ("kind", "line", "region", "depth", "quoted", "begun")

    def __init__(self, state: str | None = None) -> None:
        self.kind, self.line, self.region, self.depth, self.quoted, self.begun = json.loads(state) if state else ("", "", "", 0, False, False)

    def state(self) -> str:
        return json.dumps([getattr(self, f) for f in self.FIELDS])

    def push(self, chunk: str) -> str:
        out = []
        for part in re.findall(r"[^\n]*\n|[^\n]+", chunk):
            if self.begun and self.kind in ("", "code"):
                out.append(part)
                self.begun = not part.endswith("\n")
                continue
            self.line += part
            if self.line.endswith("\n"):
                whole, self.line = self.line, ""
                out.append(self._whole(whole))
            elif self.kind in ("", "code") and not self._may_matter():
                out.append(self.line)
                self.line, self.begun = "", True
        return "".join(out)

    def end(self) -> str:
        """What is still held, once the text has ended."""
        rest, self.line = self.line, ""
        if self.kind == "json":
            self.region += rest
            out = self._fenced("")
        elif self.kind == "raw":
            self.region += rest
            out = self._raw()
        else:
            out = rest
        self.kind, self.begun = "", False
        return out

    def _may_matter(self) -> bool:
        """Whether an unfinished line can still become a fence or the start of JSON."""
        t = self.line.lstrip(" \t")
        return _FENCE.startswith(t[:3]) or (self.kind == "" and t[0] in "{[")

    def _whole(self, line: str) -> str:
        t = line.strip()
        if self.kind == "json":
            if t == _FENCE:
                return self._fenced(line)
            self.region += line
            return ""
        if self.kind == "raw":
            self._take(line)
            return self._raw() if self.depth <= 0 else ""
        if t.startswith(_FENCE):
            named = t[3:].strip().lower()
            if self.kind == "code":
                self.kind = ""
            elif named in _JSON_NAMES:
                self.kind, self.region = "json", line
                return ""
            else:
                self.kind = "code"
        elif self.kind == "" and _OPENS.match(t):
            self.kind, self.region, self.depth, self.quoted = "raw", "", 0, False
            self._take(line)
            return self._raw() if self.depth <= 0 else ""
        return line

    def _take(self, line: str) -> None:
        self.region += line
        for m in _MARKS.finditer(line):
            if m[0] == '"':
                self.quoted = not self.quoted
            elif not self.quoted and len(m[0]) == 1:
                self.depth += 1 if m[0] in "{[" else -1

    def _raw(self) -> str:
        out, self.region, self.kind = repair_json(self.region), "", ""
        return out

    def _fenced(self, closing: str) -> str:
        opening, _, body = self.region.partition("\n")
        opening += "\n"
        if body.strip()[:1] in ("{", "["):
            body = repair_json(body)
        self.region, self.kind = "", ""
        return opening + body + closing
