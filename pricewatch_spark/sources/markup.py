"""Reading HTML as it is found: what the grammar doesn't know is passed over, never an error."""

from __future__ import annotations

from html.parser import HTMLParser


class TolerantParser(HTMLParser):
    """A parser that any text gets through.

    Marked sections (<![...]>) and declarations that aren't known end at the next >, as comments that
    browsers make of them do; without one, the rest of the page is text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def parse_marked_section(self, i, report=1):
        return self._passed_over(i, "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">")

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        if self.rawdata.startswith("<![", i):
            return self.parse_marked_section(i)
        return self._passed_over(i, ">")

    def _passed_over(self, i: int, end: str) -> int:
        at = self.rawdata.find(end, i)
        return at + len(end) if at >= 0 else -1

    def read(self, page: str) -> None:
        """The whole page."""
        self.feed(page)
        self.close()
