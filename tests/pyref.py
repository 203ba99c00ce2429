"""Plain-Python statements of the text specs, used as differential references.

The packer walks over the characters of a text and only keeps places; it shares no step with the
library, which splits into units and folds them."""

import html
import re

TAG = re.compile(r"<[^>]+>")
CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")


def pieces(text, max_length):
    """Places ``(from, to, mark)`` that must stay whole, and the mark that follows each in a chunk: lines, in
    a line over the length its sentences, in a sentence over it what stands between spaces."""
    line_from = 0
    while line_from <= len(text):
        line_to = line_from
        while line_to < len(text) and text[line_to] != "\n":
            line_to += 1
        if line_to - line_from <= max_length:
            yield line_from, line_to, "\n"
        else:
            at = first = line_from
            while at <= line_to:
                gap = at
                if line_from < at < line_to and text[at - 1] in ".!?":
                    while gap < line_to and text[gap].isspace():
                        gap += 1
                if gap > at or at == line_to:
                    if at - first <= max_length:
                        yield first, at, " "
                    else:
                        word = first
                        for place in range(first, at + 1):
                            if place == at or text[place] == " ":
                                yield word, place, " "
                                word = place + 1
                    first = gap
                at = max(gap, at + 1) if at != line_to else line_to + 1
                if gap == line_to and first == line_to and at == line_to:
                    yield line_to, line_to, " "
                    break
        line_from = line_to + 1


def chunks(text, max_length=3000):
    """Chunks by room left: a piece and its mark that don't fit close the chunk, even an empty one."""
    out, room, open_from = [], max_length, []
    for a, b, mark in pieces(text, max_length):
        if b - a + 1 > room:
            out.append("".join(open_from).strip())
            room, open_from = max_length, []
        open_from += [*text[a:b], mark]
        room -= b - a + 1
    rest = "".join(open_from).strip()
    return [*out, rest] if rest else out


def sanitize(text):
    steps = (html.unescape,
             lambda t: TAG.sub("", t),
             lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"),
             lambda t: CONTROL.sub("", t))
    for step in steps:
        text = step(text)
    return text
