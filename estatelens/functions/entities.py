"""HTML character references in Spark expressions (X16): no Python worker.

A text is cut at ``&``; only that character starts a reference, and no reference holds it. The longest name of the
HTML5 table that a part starts with comes from one regex, the table's names as a trie, and its characters from a
map in buckets. The table is the standard library's and is read when a plan is built."""

from __future__ import annotations

import html
import re
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Maps that the names are dealt over; a lookup walks through one of them.
BUCKETS = 128
NUMERIC_RE = "#[0-9]+;?|#[xX][0-9a-fA-F]+;?"


def _trie_regex(names) -> str:
    """A regex for the longest of ``names`` at a place: letters first, the end of a name where no further letter fits."""
    trie: dict = {}
    for name in names:
        node = trie
        for c in name:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [re.escape(c) + written(child) for c, child in sorted(node.items()) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return body + "?" if "" in node else body
    return written(trie)


NAMED_RE = _trie_regex(html5)
REFERENCE_RE = f"^(?:{NUMERIC_RE}|{NAMED_RE})"


def _table(pairs: dict[str, str]) -> Column:
    """``pairs`` as an array of ``BUCKETS`` maps, a key's by its crc32; constant, so built once a plan."""
    dealt: list[list[str]] = [[] for _ in range(BUCKETS)]
    for key, value in pairs.items():
        dealt[zlib.crc32(key.encode()) % BUCKETS].append(f"{key}\x02{value}")
    return F.array(*[F.str_to_map(F.lit("\x01".join(d) or "\x02"), F.lit("\x01"), F.lit("\x02")) for d in dealt])


def _found(pairs: dict[str, str], key: Column) -> Column:
    return F.get(_table(pairs), (F.crc32(key.cast("binary")) % BUCKETS).cast("int"))[key]


def code_point(n: Column) -> Column:
    """The character with number ``n`` (from 1, no surrogate)."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numbered(reference: Column) -> Column:
    """The character of ``#38;`` or ``#x26;``: unknown numbers give U+FFFD, the numbers of no character nothing, and those of
    the old code page (below 160) what browsers show."""
    is_hex = F.substr(reference, F.lit(2), F.lit(1)).isin("x", "X")
    digits = F.btrim(F.when(is_hex, F.substr(reference, F.lit(3))).otherwise(F.substr(reference, F.lit(2))), F.lit(";"))
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    number = (F.when(F.length(digits) > 8, F.lit(0x110000).cast("long")).when(is_hex, F.conv(digits, 16, 10).cast("long"))
              .otherwise(digits.cast("long")))
    old = {str(n): html.unescape(f"&#{n};") for n in range(160)}

    def character(n: Column) -> Column:
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        return (F.when(n < 160, _found(old, n.cast("string"))).when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(none, "").otherwise(code_point(n)))
    return F.get(F.transform(F.array(number), character), 0)


def unescape(text: Column) -> Column:
    """``text`` with all named and numeric character references decoded, as ``html.unescape`` does. Null stays null."""
    def decoded(part: Column) -> Column:
        def by_reference(reference: Column) -> Column:
            character = F.when(reference.startswith("#"), _numbered(reference)).otherwise(_found(html5, reference))
            return F.when(reference == "", F.concat(F.lit("&"), part)).otherwise(F.concat(character, F.substr(part, F.length(reference) + 1)))
        return F.get(F.transform(F.array(F.regexp_extract(part, REFERENCE_RE, 0)), by_reference), 0)

    # The one-element array binds the parts once; what stands before the first "&" starts no reference.
    joined = F.get(F.transform(F.array(F.split(text, "&", -1)), lambda parts: F.array_join(
        F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(decoded(part))), "")), 0)
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)
