"""What can be wrong with a query."""

from __future__ import annotations

import difflib


class QueryError(Exception):
    """A query that can't be run; ``str`` shows the place in the text."""

    def __init__(self, message: str, text: str = "", start: int = 0, end: int | None = None, help: str = ""):
        self.message, self.text, self.start, self.help = message, text, start, help
        self.end = max(start + 1, start + 1 if end is None else end)
        super().__init__(self.report())

    def report(self) -> str:
        if not self.text:
            return self.message
        line = self.text.count("\n", 0, self.start)
        begin = self.text.rfind("\n", 0, self.start) + 1
        row = self.text[begin:].split("\n", 1)[0]
        mark = " " * (self.start - begin) + "^" * max(1, min(self.end, begin + len(row)) - self.start)
        return f"{self.message}\n  |\n{line + 1} | {row}\n  | {mark}" + (f"\n  = help: {self.help}" if self.help else "")


class SyntaxError_(QueryError):
    """The text isn't a query."""


class PlanError(QueryError):
    """The query can be read but makes no sense."""


def nearest(word: str, known) -> str:
    found = difflib.get_close_matches(word, list(known), 1, 0.6)
    return f"did you mean '{found[0]}'?" if found else ""
