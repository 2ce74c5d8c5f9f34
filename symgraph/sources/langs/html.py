"""Facts of HTML files: elements with an id, scripts and linked files."""

from __future__ import annotations

from html.parser import HTMLParser

from .facts import Facts


class Reader(HTMLParser):
    def __init__(self, facts: Facts) -> None:
        super().__init__(convert_charrefs=True)
        self.f = facts

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        line, col = self.getpos()
        text = self.get_starttag_text() or ""
        at = (line - 1, col, line - 1 + text.count("\n"), col + len(text) if "\n" not in text else len(text) - text.rfind("\n") - 1)
        have = dict(attrs)
        if have.get("id"):
            self.f.define("variable", have["id"], at)
        target = have.get("src") if tag == "script" else have.get("href") if tag == "link" else None
        if target:
            self.f.refer("import", [target], at, "attribute", target, None, target)


def read(facts: Facts, text: str) -> None:
    reader = Reader(facts)
    reader.feed(text)
    reader.close()
