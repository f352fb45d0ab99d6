"""Readable text out of HTML, Markdown, wiki and LaTeX markup, mixed and broken.

A scanner turns every notation into one stream of open, close and text events. A tree
builder with implied tags makes a tree of them, and a renderer emits all visible text:
blocks apart, headings on lines of their own, list items with bullets or numbers, table
cells aligned, code and formulas as they stand. What the scanner takes for markup is
counted, which also tells which texts hold any.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by the way they are laid out.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark math nowiki q ref references gallery s samp small span strike strong sub sup syntaxhighlight time tt u var wbr script style noinclude includeonly onlyinclude poem blink button select option textarea title head meta link template object video audio source".split())
VOID = set("br hr img input meta link wbr source references".split())
HIDDEN = set("script style head title template ref references select".split())
RAW = "pre|code|nowiki|math|script|style|syntaxhighlight|ref"
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"},
}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
# LaTeX commands whose argument is text to show, and those that show nothing.
TEX_SHOWN = "textbf|textit|emph|texttt|textsc|textsf|underline|textrm|mbox|title|author|caption|footnote|uline|textsuperscript|textsubscript|text"
TEX_SILENT = r"\\(?:begin|end|documentclass|usepackage|label|ref|eqref|pageref|cite\w*|includegraphics|input|include|bibliography\w*|pagestyle|thispagestyle|setlength|hspace|vspace|newcommand|renewcommand|color|fontsize|selectlanguage|index|setcounter|addtocounter)\b"
TEX_HEAD = "chapter|section|subsection|subsubsection|paragraph|part"
TEX_GROUP = "it|bf|em|tt|sc|sl|rm|itshape|bfseries|small|large|Large"
FILE_OPTIONS = re.compile(r"^\s*(thumb(nail)?|frame(d|less)?|border|left|right|center|none|upright.*|\d+x?\d*px|alt=.*|link=.*)\s*$", re.I)

_BROKEN = r"(?:\s[\w:.-]+\s*=\s*[^<>]*)?"  # the rest of a list that broke off inside
# A tag holds attributes with values, or bare ones after them or of HTML's own; '<b and c>' is none.
_BARE = r"(?:hidden|disabled|checked|selected|readonly|required|open|reversed|nowrap|noshade|compact|controls|autoplay|loop|muted|async|defer|multiple|inline)"
_ATTR = rf"(?:[\w:.-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']*)|{_BARE})"
_TAG = r"(?i:</?(?:" + "|".join(sorted(BLOCKS | INLINE | {"h[1-6]"}, key=lambda x: (-len(x), x))) + rf")(?:\s+{_ATTR})*(?:\s*{_BROKEN}|\s*/?)>)"
_CUT_TAG = r"</?(?:" + "|".join(sorted((BLOCKS | INLINE) - {"a", "b", "i", "s", "u", "q", "p"}, key=lambda x: (-len(x), x))) + r")\b(?:\s+[\w-]+(?:=\"?[^\"<>\n]*\"?)?)*(?=\s|$|<)"
# Attributes of a table; what follows them in its line is text.
_ATTRS = r"(?:[ \t]*[^\s=\"|]+=(?:\"[^\"\n]*\"?|[^\s\"|]+))*[ \t]*"
# Every construct begins with one of these; other places are passed over at once.
_FIRST = r"(?=[<`~&$\\{}|\[\]!'*_]|thumb\||left\||right\||class=|style=|href=|colspan=)"
_MASTER = re.compile(
    _FIRST + r"(?:(?P<comment><!--.*?(?:-->|$(?![\s\S])))"
    r"|(?P<fence>^(?:```|~~~)[^\n`]*\n(?:.*?\n)?(?:```|~~~)[ \t]*$|^(?:```|~~~)\w*[ \t]*$)"
    rf"|(?P<raw><(?P<rawname>(?i:{RAW}))\b[^<>]*(?<!/)>(?P<rawbody>.*?)</(?P=rawname)\s*>)"
    rf"|(?P<tag>{_TAG})"
    rf"|(?P<cuttag>{_CUT_TAG}|(?:(?<=\s)|^)(?:class|style|href|colspan)=\"[^\"\n]*\"(?:\s*/?>)?)"
    r"|(?P<entity>&(?:[A-Za-z][A-Za-z0-9]{1,9}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});)"
    r"|(?P<display>\$\$.+?\$\$|\\\[.+?\\\]|\\begin\{(?P<env>equation|align|displaymath|math)\*?\}.*?\\end\{(?P=env)\*?\})"
    r"|(?P<math>\\\(.+?\\\)|(?<![\w$\\])\$(?=[^\s$])(?=[^$\n]*(?:[\\^_={}]|[A-Za-z]))(?!\d[\d.,]*[\s)])[^$\n]*?[^\s$\\]\$(?![\w$]))"
    rf"|(?P<texhead>\\(?:{TEX_HEAD})\*?\{{(?P<texheadbody>[^{{}}\n]*)\}}?)"
    r"|(?P<texenv>\\(?P<texenvop>begin|end)\{(?P<texenvname>[A-Za-z]+\*?)\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})?)"
    r"|(?P<texitem>\\item\b[ \t]*(?:\[[^\]\n]*\])?)"
    rf"|(?P<texshown>\\(?:{TEX_SHOWN})\{{)"
    rf"|(?P<texgroup>\{{\\(?:{TEX_GROUP})\b[ \t]?)"
    r"|(?P<texcmd>(?<![\w:\\])\\[A-Za-z]{2,}\*?(?!\\)(?:\[[^\]\n]*\])?(?P<texargs>(?:\{[^{}\n]*\})*))"
    rf"|(?P<tablestart>\{{\|{_ATTRS})|(?P<tableend>\|\}})"
    r"|(?P<link>\[\[(?P<linkbody>[^\[\]\n]*)\]\])"
    r"|(?P<mdimage>!\[[^\[\]\n]*\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\))"
    r"|(?P<mdlink>\[(?P<mdtext>[^\[\]\n]+)\]\((?P<mdurl>[^()\s]*)(?:\s+\"[^\"\n]*\")?\))"
    r"|(?P<extlink>\[(?:https?|ftp|mailto):[^\s\[\]]+(?:\s+(?P<exttext>[^\[\]\n]*))?\])"
    r"|(?P<note>\[\^[\w-]{1,20}\]:?)"
    r"|(?P<cutlink>\[\[(?:[^\[\]|\n]+\|)?|\]\]|\]\((?:https?://[^()\s]*\)?|(?=\S)[^()\s]*\))|\[(?:https?)://\S*|\[\[?$(?![\s\S]))"
    r"|(?P<template>\{\{|\}\})"
    r"|(?P<thumb>(?<![\w\[])thumb\|(?:\d+px\|)?|\|\d+px\||\b(?:left|right)\|\d+px\||\|thumb\b\|?)"
    r"|(?P<quotes>'''''|'''|''(?!'))"
    r"|(?P<mdstrong>\*\*(?=[^\s*])|(?<=[^\s*])\*\*|__(?=[^\s_])|(?<=[^\s_])__|~~)"
    r"|(?P<mdem>(?<![\w*])\*(?=[^\s*])(?P<mdembody>[^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_]))"
    r"|(?P<cutem>(?<![\w_*])[_*](?=\w)|(?<=[\w.,;!?])_(?![\w_]))"
    r"|(?P<code>`+(?P<codebody>[^`\n]+)`+|`+))",
    re.M | re.S,
)
_WIKIHEAD = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\n].*?)[ \t]*(={1,6})[ \t]*$")
_MDHEAD = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*$")
_CUTHEAD = re.compile(r"^[ \t]*={2,6}[ \t]*([^=\n]*)$|^([^=\n]*[^=\s])[ \t]*={2,6}[ \t]*$")
_SETEXT = re.compile(r"^(?:={3,}|-{3,})[ \t]*$")
_WIKILIST = re.compile(r"^([*#]+|[*#:;]{2,})[ \t]*(\S.*)$")
_MDLIST = re.compile(r"^([ \t]*)([-+])[ \t]+(\S.*)$")
_DEF = re.compile(r"^([;:])[ \t]*(\S.*)$")
_QUOTE = re.compile(r"^[ \t]*(>+)[ \t]?(.*)$")
_MDROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$")
_MDRULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$")
_RULE = re.compile(r"^[ \t]*(?:-{4,}|\*{3,}|_{3,})[ \t]*$")
_FRONT = re.compile(r"\A---[ \t]*\n((?:[A-Za-z_][\w-]*:.*\n|[ \t]+.*\n|\n)+)---[ \t]*(?:\n|\Z)")
_CATEGORY = re.compile(r"^(?:Category|Catégorie|Kategorie|Categoría|Categoria|カテゴリ):\S.*$", re.I)
_MAGIC = re.compile(r"__(?:NOTOC|TOC|NOEDITSECTION|FORCETOC)__|#REDIRECT\b")
_SUSPECT = re.compile(r"[<>&\[\]{}|*_~`#=\\$]|''|^[ \t]*[-+>;:][ \t]?\S|^-{3,}|Category:|Kategor", re.M)


class Node:
    __slots__ = ("name", "kids", "level", "hidden")

    def __init__(self, name: str, hidden: bool = False, level: int = 0):
        self.name, self.kids, self.hidden, self.level = name, [], hidden, level


class Tree:
    """HTML-like tree builder: closes what a new element implies is over."""

    def __init__(self) -> None:
        self.root = Node("body")
        self.stack = [self.root]

    def open(self, name: str, hidden: bool = False, level: int = 0) -> None:
        if name in BLOCKS and self.stack[-1].name == "p":
            self.stack.pop()
        for i in range(len(self.stack) - 1, 0, -1):
            at = self.stack[i].name
            if at in SCOPE.get(name, ()):
                break
            if at in CLOSED_BY.get(name, ()):
                del self.stack[i:]
        node = Node(name, hidden, level)
        self.stack[-1].kids.append(node)
        if name not in VOID:
            self.stack.append(node)

    def close(self, name: str) -> None:
        """Close the innermost ``name`` and what is open in it; nothing if there is none.
        Inline elements do not close the block they stand in."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                del self.stack[i:]
                return
            if name not in BLOCKS and self.stack[i].name in BLOCKS:
                return

    def text(self, s: str) -> None:
        if s:
            self.stack[-1].kids.append(s)

    def leaf(self, name: str, s: str) -> None:
        node = Node(name)
        node.kids.append(s)
        if name == "pre" and self.stack[-1].name == "p":
            self.stack.pop()
        self.stack[-1].kids.append(node)


class Scanner:
    def __init__(self, text: str):
        self.tree, self.hits, self.source, self.no_end = Tree(), 0, text, 0

    def hit(self) -> None:
        self.hits += 1

    # -- lines: headings, lists, quotes, tables ---------------------------------------

    def run(self) -> Tree:
        text = self.source.replace("\r\n", "\n").replace("\r", "\n")
        m = _FRONT.match(text)
        if m:
            self.hit()
            for line in m.group(1).strip("\n").split("\n"):
                key, _, value = line.partition(":")
                if value.strip():
                    self.block("p", f"{key.strip()}: {value.strip().strip(chr(34))}", plain=True)
            text = text[m.end():]
        for piece, kind in self.split(text):
            if kind:
                self.special(kind, piece)
            else:
                self.lines(piece)
        return self.tree

    def split(self, text: str) -> Iterator[tuple]:
        """Parts that span lines (code, comments, displayed formulas) apart from the rest."""
        at = 0
        if "```" in text or "~~~" in text or "<" in text or "$$" in text or "\\[" in text or "\\begin" in text:
            for m in _MASTER.finditer(text):
                if m.lastgroup and any(m.group(g) is not None for g in ("comment", "fence", "raw", "display")):
                    yield text[at:m.start()], None
                    kind = next(g for g in ("comment", "fence", "raw", "display") if m.group(g) is not None)
                    yield m, kind
                    at = m.end()
        yield text[at:], None

    def special(self, kind: str, m: re.Match) -> None:
        self.hit()
        body = m.group()
        if kind == "fence":
            inner = body.split("\n")[1:-1]
            if inner:
                self.tree.leaf("pre", "\n".join(inner))
        elif kind == "display":
            inner = re.sub(r"^(?:\$\$|\\\[|\\begin\{\w+\*?\})|(?:\$\$|\\\]|\\end\{\w+\*?\})$", "", body).strip()
            self.tree.leaf("pre", inner)
        elif kind == "raw":
            name, inner = m.group("rawname").lower(), m.group("rawbody")
            if name in HIDDEN:
                return
            if name == "pre" or (name in ("code", "syntaxhighlight") and "\n" in inner):
                self.tree.leaf("pre", html.unescape(re.sub(r"<[^<>\n]+>", "", inner)).strip("\n"))
            else:
                self.tree.leaf("span", html.unescape(inner))

    def lines(self, text: str) -> None:
        rows = text.split("\n")
        i, n, self.no_end = 0, len(rows), 0
        lists: list[str] = []

        def end_lists(keep: int = 0) -> None:
            while len(lists) > keep:
                self.tree.close("dl" if lists[-1] in ";:" else "ol" if lists[-1] == "#" else "ul")
                lists.pop()

        def item(marks: str, body: str) -> None:
            common = 0
            while common < min(len(lists), len(marks)) and (lists[common] in ";:") == (marks[common] in ";:") and (lists[common] == marks[common] or marks[common] in ";:"):
                common += 1
            end_lists(common)
            while len(lists) < len(marks):
                mark = marks[len(lists)]
                self.tree.open("dl" if mark in ";:" else "ol" if mark == "#" else "ul")
                lists.append(mark)
            self.tree.open({";": "dt", ":": "dd"}.get(marks[-1], "li"))
            self.inline(body)

        while i < n:
            row = rows[i]
            bare = row.strip()
            if not bare:
                end_lists()
                self.tree.close("p")
                self.tree.text("\n\n") if self.tree.stack[-1].name in ("pre",) else None
                if self.tree.stack[-1].name == "body" or self.tree.stack[-1].name in BLOCKS:
                    self.tree.stack[-1].kids.append(Node("gap"))
                i += 1
                continue
            m = _WIKIHEAD.match(row)
            if m and min(len(m.group(1)), len(m.group(3))) >= 2 or (m and len(m.group(1)) == len(m.group(3)) == 1):
                end_lists()
                self.hit()
                self.block("h", m.group(2))
                i += 1
                continue
            m = _MDHEAD.match(row)
            if m:
                end_lists()
                self.hit()
                self.block("h", m.group(2))
                i += 1
                continue
            if i + 1 < n and _SETEXT.match(rows[i + 1]) and not _SETEXT.match(row) and (i == 0 or not rows[i - 1].strip() or rows[i + 1].lstrip()[0] == "="):
                end_lists()
                self.hit()
                self.block("h", bare)
                i += 2
                continue
            if _RULE.match(row) or (_SETEXT.match(row) and bare[0] == "-"):
                end_lists()
                self.hit()
                self.tree.open("hr")
                i += 1
                continue
            if _SETEXT.match(row):
                self.hit()
                i += 1
                continue
            m = _CUTHEAD.match(row)
            if m and (m.group(1) or m.group(2)):
                end_lists()
                self.hit()
                self.block("h", m.group(1) or m.group(2))
                i += 1
                continue
            if _CATEGORY.match(bare):
                self.hit()
                i += 1
                continue
            if bare.startswith("{|"):
                end_lists()
                i = self.wiki_table(rows, i)
                continue
            if _MDROW.match(row) and (i + 1 < n and _MDRULE.match(rows[i + 1]) or i and _MDRULE.match(rows[i - 1]) or bare.count("|") > 2):
                end_lists()
                i = self.md_table(rows, i)
                continue
            if _MDRULE.match(row) and "|" in row:
                self.hit()
                i += 1
                continue
            m = _WIKILIST.match(row)
            if m and not (m.group(1) == "#" and re.match(r"#\d", row)) and not (m.group(1) == "*" and re.match(r"\*[^*\n]+\*(?!\*)", row)) and not (m.group(1) == "**" and "**" in m.group(2)):
                self.hit()
                item(m.group(1), m.group(2))
                i += 1
                continue
            m = _MDLIST.match(row)
            if m:
                if re.search(r"\*\*|\[|`|__", m.group(3)) or (i and _MDLIST.match(rows[i - 1])) or (i + 1 < n and _MDLIST.match(rows[i + 1])):
                    item("*" * (1 + len(m.group(1).expandtabs(4)) // 2), m.group(3))
                    i += 1
                    continue
            m = _DEF.match(row)
            if m and (m.group(1) == ";" or lists):
                self.hit()
                item(m.group(1), m.group(2))
                i += 1
                continue
            if m and re.match(r"^:+\s*\S", row) and not re.match(r"^:[\-)(DPp]", row):
                self.hit()
                item(":", m.group(2))
                i += 1
                continue
            m = _QUOTE.match(row)
            if m and m.group(2).strip():
                end_lists()
                self.hit()
                self.block("blockquote", m.group(2))
                i += 1
                continue
            end_lists()
            if self.tree.stack[-1].name in ("body", "div", "blockquote", "section") or not any(x.name == "p" for x in self.tree.stack):
                if self.tree.stack[-1].name in ("body", "div", "section"):
                    self.tree.open("p")
            elif self.tree.stack[-1].kids:
                self.tree.text("\n")
            # A template may run over several lines.
            depth = row.count("{{") - row.count("}}")
            if depth > 0 and (stop := self.template_end(rows, i, depth)):
                row = "\n".join(rows[i : stop + 1])
                i = stop
            self.inline(row)
            i += 1
        end_lists()

    def template_end(self, rows: list[str], i: int, depth: int) -> int:
        """The row in which the templates left open in row ``i`` end, else 0. Where the rest
        of the text has no end for them no later row is asked again."""
        if i < self.no_end:
            return 0
        for k in range(i + 1, len(rows)):
            depth += rows[k].count("{{") - rows[k].count("}}")
            if depth <= 0:
                return k
        self.no_end = len(rows)
        return 0

    def block(self, name: str, body: str, plain: bool = False) -> None:
        self.tree.close("p")
        self.tree.open(name)
        self.tree.text(body) if plain else self.inline(body)
        while self.tree.stack[-1].name != name and len(self.tree.stack) > 1:
            self.tree.stack.pop()
        if len(self.tree.stack) > 1:
            self.tree.stack.pop()

    def wiki_table(self, rows: list[str], i: int) -> int:
        self.hit()
        self.tree.close("p")
        self.tree.open("table")
        self.tree.open("tr")
        closed, first, rest, over = self.table_closed(rows, i), True, "", False
        while i < len(rows) and not over:
            row = rows[i].strip()
            i += 1
            if first:
                row, first = re.sub(rf"^\{{\|{_ATTRS}", "", row), False
            elif not row and not closed and not next((r for r in map(str.strip, rows[i:]) if r), "").startswith(("|", "!")):
                break
            if row.startswith("|}"):
                rest = row[2:].strip()
                break
            if row.endswith("|}"):
                row, over = row[:-2].rstrip(), True
            if row.startswith("|-"):
                self.tree.open("tr")
            elif row.startswith("|+"):
                self.tree.open("caption")
                self.inline(row[2:].strip())
                self.tree.close("caption")
            elif row[:1] in ("|", "!"):
                mark = row[0]
                for cell in re.split(r"\|\||!!" if mark == "!" else r"\|\|", row[1:]):
                    head = re.match(r"\s*(?:[\w-]+=(?:\"[^\"]*\"|\S+)\s*)+\|(?!\|)", cell)
                    span = re.search(r"colspan=\"?(\d{1,3})", head.group()) if head else None
                    cell = cell[head.end() :] if head else cell
                    self.tree.open("th" if mark == "!" else "td", level=int(span.group(1)) if span else 0)
                    self.inline(cell.strip())
            elif row:
                if next((x.name for x in reversed(self.tree.stack) if x.name in ("td", "th", "tr", "table")), "") in ("tr", "table"):
                    self.tree.open("td")
                m = _WIKILIST.match(row) or _DEF.match(row)
                if m:
                    self.tree.text("\n" + ("- " if m.group(1)[0] in "*#" else ""))
                    self.inline(m.group(2))
                else:
                    self.tree.text("\n")
                    self.inline(row)
        self.tree.close("table")
        if rest:
            self.block("p", rest)
        return i

    @staticmethod
    def table_closed(rows: list[str], i: int) -> bool:
        """Whether the table that begins in row ``i`` has an end of its own."""
        depth = 0
        for row in map(str.strip, rows[i:]):
            depth += row.startswith("{|")
            depth -= row.startswith("|}") or row.endswith("|}")
            if depth <= 0:
                return True
        return False

    def md_table(self, rows: list[str], i: int) -> int:
        self.hit()
        self.tree.close("p")
        self.tree.open("table")
        while i < len(rows) and ("|" in rows[i]) and (_MDROW.match(rows[i]) or _MDRULE.match(rows[i])):
            if not _MDRULE.match(rows[i]):
                self.tree.open("tr")
                for cell in rows[i].strip().strip("|").split("|"):
                    self.tree.open("td")
                    self.inline(cell.strip())
            i += 1
        self.tree.close("table")
        return i

    # -- inside lines -------------------------------------------------------------------

    def inline(self, s: str) -> None:
        at, tree = 0, self.tree
        closers: list[str] = []  # LaTeX groups that are open
        for m in _MASTER.finditer(s):
            if m.start() < at:
                continue
            between = s[at:m.start()]
            self.plain(between, closers)
            at = m.end()
            kind = next(k for k in _KINDS if m.group(k) is not None)
            got = m.group()
            if kind in ("mdem", "cutem", "mdstrong", "code") and not self.emphasis(kind, m, s):
                self.plain(got, closers)
                continue
            self.hit()
            if kind == "tag":
                self.tag(got)
            elif kind == "entity":
                tree.text(html.unescape(got).replace("\xa0", " "))
            elif kind in ("comment", "cuttag", "note", "cutlink", "thumb", "quotes"):
                pass
            elif kind == "mdimage":
                self.inline(got[2 : got.index("](")])
            elif kind == "texcmd":
                self.command(got, m.group("texargs"))
            elif kind == "raw":
                self.hits -= 1
                self.special("raw", m)
            elif kind == "display":
                self.hits -= 1
                self.special("display", m)
            elif kind == "math":
                tree.leaf("span", re.sub(r"^(?:\$|\\\()|(?:\$|\\\))$", "", got))
            elif kind == "texhead":
                self.block("h", m.group("texheadbody"))
            elif kind == "texenv":
                name = m.group("texenvname").rstrip("*")
                tag = {"itemize": "ul", "enumerate": "ol", "quote": "blockquote", "verbatim": "pre", "tabular": "div"}.get(name)
                if tag:
                    tree.open(tag) if m.group("texenvop") == "begin" else tree.close(tag)
            elif kind == "texitem":
                tree.open("li")
            elif kind in ("texshown", "texgroup"):
                closers.append("}")
            elif kind == "link":
                self.link(m.group("linkbody"))
            elif kind == "mdlink":
                self.inline(m.group("mdtext"))
            elif kind == "extlink":
                self.inline(m.group("exttext") or "")
            elif kind == "template":
                if got == "{{":
                    at = self.template(s, m.end())
            elif kind == "code":
                if m.group("codebody"):
                    tree.leaf("span", m.group("codebody"))
            elif kind == "mdem":
                self.plain(got[1:-1], closers)
        self.plain(s[at:], closers)

    def command(self, got: str, args: str) -> None:
        """An unknown LaTeX command shows its last argument; one of the page's make-up nothing."""
        if args and not re.match(TEX_SILENT, got):
            self.inline(args[args.rindex("{") + 1 : -1])

    def plain(self, s: str, closers: list[str]) -> None:
        while closers and "}" in s:
            closers.pop()
            s = s.replace("}", "", 1)
        s = _MAGIC.sub(self.magic, s)
        self.tree.text(s)

    def magic(self, m: re.Match) -> str:
        self.hit()
        return ""

    def emphasis(self, kind: str, m: re.Match, s: str) -> bool:
        """Is this a mark, not an ordinary sign? Stars by figures and footnotes are signs."""
        before, after = s[: m.start()], s[m.end():]
        if kind == "cutem":
            if m.group() == "_":
                if re.search(r"\w$", before) and not re.match(r"\w", after):
                    return before.count("_") - before.count("__") * 2 > 0  # the close of a mark that was opened
                return not re.search(r"[\w/]$", before) or not re.match(r"\w", after)
            return not re.match(r"\d", after)
        if kind == "mdem" and m.group()[0] == "*":
            return not re.fullmatch(r"[\d\s.,*]+", m.group())
        return True

    def tag(self, got: str) -> None:
        name = re.match(r"</?\s*([A-Za-z][A-Za-z0-9]*)", got).group(1).lower()
        name = "h" if re.fullmatch(r"h[1-6]", name) else name
        if got.startswith("</"):
            self.tree.text("\n") if name == "br" else self.tree.close(name)
            return
        if name == "br":
            self.tree.text("\n")
            return
        hidden = name in HIDDEN or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden|\shidden(?:\s|=|>|/)|aria-hidden\s*=\s*[\"']?true", got, re.I))
        if got.endswith("/>") and name not in VOID:
            return
        if name == "img":
            alt = re.search(r"alt\s*=\s*\"([^\"]*)\"", got)
            self.tree.text(alt.group(1) if alt else "")
            return
        span = re.search(r"colspan\s*=\s*[\"']?(\d{1,3})", got, re.I) if name in ("td", "th") else None
        self.tree.open(name, hidden, int(span.group(1)) if span else 0)

    def link(self, body: str) -> None:
        target, *rest = body.split("|")
        space = target.strip().lstrip(":").partition(":")[0].strip().lower()
        if not target.strip().startswith(":") and space in ("category", "kategorie", "catégorie", "categoría", "categoria"):
            return
        if space in ("file", "image", "datei", "fichier", "archivo"):
            shown = [x for x in rest if not FILE_OPTIONS.match(x)]
            self.inline(shown[-1] if shown else "")
            return
        self.inline(rest[-1] if rest and rest[-1].strip() else target.strip().lstrip(":"))

    def template(self, s: str, start: int) -> int:
        """Show what a template shows: its positional values, or the fields of a box."""
        depth, end = 1, start
        for m in re.finditer(r"\{\{|\}\}", s[start:]):
            depth += 1 if m.group() == "{{" else -1
            if depth == 0:
                end = start + m.start()
                break
        if depth:
            return start
        body = s[start:end]
        parts = [p.strip() for p in re.split(r"\|(?![^\[\]{}]*(?:\]\]|\}\}))", body)]
        named = [p for p in parts[1:] if re.match(r"[\w ]+=", p)]
        shown = [p for p in parts[1:] if p and p not in named]
        if named and "\n" in body:
            for p in named:
                key, _, value = p.partition("=")
                if value.strip():
                    self.block("p", f"{key.strip()}: {value.strip()}")
        elif not shown and named:
            values = [v.strip() for p in named for k, _, v in [p.partition("=")] if re.match(r"(?i)\s*(text|quote|title|content|caption|name|label|note|1|2|3)\s*$", k) and v.strip()]
            self.inline(": ".join(values))
        elif shown:
            if re.match(r"(?i)\s*(w|wp|wikipedia|lang|nihongo)\b", parts[0]):
                self.inline(shown[-1])
            else:
                self.inline(": ".join(shown))
        return end + 2


_KINDS = ("comment", "fence", "raw", "tag", "cuttag", "entity", "display", "math", "texhead", "texenv", "texitem", "texshown", "texgroup", "texcmd", "tablestart", "tableend", "link", "mdimage", "mdlink", "extlink", "note", "cutlink", "template", "thumb", "quotes", "mdstrong", "mdem", "cutem", "code")


# -- rendering -----------------------------------------------------------------------------


def width(s: str) -> int:
    """Columns a string takes; wide letters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _inline_text(node: Node) -> str:
    out = []
    for k in node.kids:
        if isinstance(k, str):
            out.append(k)
        elif not k.hidden and k.name not in HIDDEN:
            out.append(_inline_text(k) if k.name not in BLOCKS else "\n" + _inline_text(k) + "\n")
    return "".join(out)


def _tidy(s: str) -> str:
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in s.split("\n")]
    return "\n".join(x for x in lines if x)


def _blocks(node: Node, out: list[tuple[str, str]], depth: int = 0) -> None:
    """Append (kind, text) blocks of a node in reading order."""
    run: list[str] = []

    def flush() -> None:
        s = _tidy("".join(run))
        run.clear()
        if s:
            out.append(("p", s))

    for k in node.kids:
        if isinstance(k, str):
            run.append(k)
        elif k.hidden or k.name in HIDDEN:
            continue
        elif k.name == "gap":
            flush()
        elif k.name == "pre":
            flush()
            body = "".join(x if isinstance(x, str) else _inline_text(x) for x in k.kids).strip("\n")
            if body.strip():
                out.append(("pre", "\n".join("    " + x for x in body.split("\n"))))
        elif k.name in ("ul", "ol", "dl"):
            flush()
            rows: list[str] = []
            _list(k, rows, 0)
            if rows:
                out.append(("list", "\n".join(rows)))
        elif k.name == "table":
            flush()
            s = _table(k)
            if s:
                out.append(("table", s))
        elif k.name == "h":
            flush()
            s = _tidy(_inline_text(k))
            if s:
                out.append(("h", s))
        elif k.name == "hr":
            flush()
        elif k.name in BLOCKS:
            flush()
            _blocks(k, out, depth + 1)
        else:
            inner: list[tuple[str, str]] = []
            if any(isinstance(x, Node) and x.name in BLOCKS | {"pre", "h"} for x in k.kids):
                flush()
                _blocks(k, inner, depth + 1)
                out.extend(inner)
            else:
                run.append(_inline_text(k))
    flush()


def _list(node: Node, rows: list[str], depth: int) -> None:
    n = 0
    for k in node.kids:
        if isinstance(k, str):
            if k.strip():
                rows.append("  " * depth + _tidy(k))
            continue
        if k.hidden:
            continue
        if k.name in ("ul", "ol", "dl"):
            _list(k, rows, depth + 1)
            continue
        n += 1
        flat = Node("span")
        nested = [x for x in k.kids if isinstance(x, Node) and x.name in ("ul", "ol", "dl")]
        flat.kids = [x for x in k.kids if x not in nested]
        mark = f"{n}. " if node.name == "ol" else "" if k.name in ("dt", "dd") else "- "
        text = _tidy(_inline_text(flat))
        if text:
            first, *more = text.split("\n")
            pad = "  " * (depth + (k.name == "dd"))
            rows.append(pad + mark + first)
            rows.extend(pad + " " * len(mark) + x for x in more)
        for x in nested:
            _list(x, rows, depth + 1)


def _table(node: Node) -> str:
    grid: list[list[str]] = []
    captions: list[str] = []

    def walk(x: Node) -> None:
        for k in x.kids:
            if isinstance(k, str) or k.hidden:
                continue
            if k.name == "caption":
                captions.append(_tidy(_inline_text(k)))
            elif k.name in ("td", "th"):
                if not grid:
                    grid.append([])
                grid[-1].append(_tidy(_inline_text(k)))
                grid[-1].extend([""] * (k.level - 1))
            else:
                if k.name == "tr":
                    grid.append([])
                walk(k)

    walk(node)
    grid = [r for r in grid if any(r)]
    if not grid:
        return "\n".join(c for c in captions if c)
    n = max(map(len, grid))
    wide = [max([0, *(max(map(width, r[j].split("\n"))) for r in grid if j < len(r))]) for j in range(n)]
    rows = [c for c in captions if c]
    for r in grid:
        cells = [c.split("\n") for c in r]
        for i in range(max(map(len, cells))):
            line = [(c[i] if i < len(c) else "") for c in cells]
            rows.append("  ".join(x + " " * (wide[j] - width(x)) for j, x in enumerate(line)).rstrip())
    return "\n".join(rows)


def render(text: str | None) -> tuple[str | None, int]:
    """(readable text, constructs of markup found). Null gives (null, 0), '' gives ('', 0).

    A text without markup comes back as it is, but for blanks at its ends.
    """
    if not text:
        return text, 0
    if not _SUSPECT.search(text):
        return text.strip(), 0
    scanner = Scanner(text)
    tree = scanner.run()
    if not scanner.hits:
        return text.strip(), 0
    blocks: list[tuple[str, str]] = []
    _blocks(tree.root, blocks)
    return "\n\n".join(s for _, s in blocks), scanner.hits


def has_markup(text: str | None) -> bool:
    return render(text)[1] > 0


def clean_text(df: DataFrame, column: str, out: str = "readable", marks: str = "marks") -> DataFrame:
    """Adds the readable text of ``column`` and the number of markup constructs in it."""
    schema = f"{out} string, {marks} int"

    @F.pandas_udf(schema)
    def both(texts: pd.Series) -> pd.DataFrame:
        got = [render(t) for t in texts]
        return pd.DataFrame({out: [g[0] for g in got], marks: [g[1] for g in got]})

    return df.withColumn("_both", both(F.col(column))).select("*", f"_both.{out}", f"_both.{marks}").drop("_both")


def marked_fields(fields: DataFrame) -> DataFrame:
    """Fields that hold markup: rows of (origin, rec_id, field, text) come out once a field
    as (origin, rec_id, field)."""

    @F.pandas_udf("boolean")
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(has_markup)

    return fields.where(marked("text")).select("origin", "rec_id", "field").distinct()
