"""Rows of markup documents: tables of HTML, elements of XML.

HTML tables are read in one pass over their tags. A table of plain rows, as
exchanges publish them, is one match and its cells are cut out of it; any other
document takes the general way.

There a document is scanned once: one pattern finds the tags that make tables, and a
fold over them keeps the depth of nested tables, the open row and the open
cell. What follows from there, row by row, costs one step a cell, however many
rows a document has.

A table's rows and cells are its own: a table inside a cell is part of that
cell's text. Closing tags may be missing. A cell that spans columns or rows
stands in each of them.
"""

import html
import re
from xml.etree import ElementTree

# a whole row of cells that hold text only; or a tag, the text behind it, and the closing tag of a cell right after that,
# which makes a plain cell one match; comments and scripts hold no markup, a quoted attribute may hold a closing bracket
ATTRIBUTES = r"""(?:[^>"'<]++|"[^"<]*"|'[^'<]*')*+[^><]*"""
TAGS = re.compile(
    rf"""<(?:(?-i:tr>((?:<td>[^<]*+</td>)++|(?:<th>[^<]*+</th>)++)</tr>)|(/?)(t(?:[dhr]|able|head|body|foot))(?=[\s/>])({ATTRIBUTES})>
    |!--.*?(?:-->|\Z)|(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)
    |/?[a-z!?]{ATTRIBUTES}>
    |())([^<]*+)(?:</t[dh]\s*>([^<]*+))?""", re.I | re.S | re.X)
# a document up to the end of its first table, whose rows have plain cells with no more than marks of style inside; nothing in
# front of the table hides tags; groups: rows of the head and of the body, or rows without sections
STYLE = r"</?(?:b|i|u|em|font|span|strong)>"
CELL = rf"[^<]*+(?:{STYLE}[^<]*+)*+"
ROWS = rf"(?:<tr>(?:(?:<td>{CELL}</td>)++|(?:<th>{CELL}</th>)++)</tr>[^<]*+)*+"
PLAIN = re.compile(
    rf"""(?:[^<]++|<(?!/?(?i:table|script|style)\b)/?[a-zA-Z][^<>"']*+>)*+<(?i:table)(?=[\s>])(?:[^>"'<]++|"[^"<]*"|'[^'<]*')*+>[^<]*+"""
    rf"""(?:<thead>[^<]*+({ROWS})</thead>[^<]*+<tbody>[^<]*+({ROWS})</tbody>[^<]*+|({ROWS}))</(?i:table)>""")
STYLES = re.compile(STYLE)
SPAN = re.compile(r"""\b(col|row)span\s*=\s*["']?\s*(\d+)""", re.I)
MOST_ACROSS, MOST_DOWN = 1000, 65534


def spans(attributes: str) -> tuple:
    """How many columns and rows a cell stands in."""
    if "span" not in attributes.lower():
        return 1, 1
    found = {which.lower(): int(n[:6]) for which, n in SPAN.findall(attributes)}
    return min(max(found.get("col", 1), 1), MOST_ACROSS), min(max(found.get("row", 1), 1), MOST_DOWN)


def first_table(text: str) -> list:
    """Rows (section, cells) of a document's first table.

    A section is a name and a number, ``("", 0)`` outside of them; a cell is
    (title?, text, columns, rows).
    """
    rows, section, sections, depth = [], ("", 0), 0, 0
    row = cell = None  # an open cell: (title?, pieces of text, attributes)
    for plain, closing, name, attributes, bare, tail, after in map(re.Match.groups, TAGS.finditer(text)):
        if plain is not None:
            is_title, texts = plain[2] == "h", plain[4:-5].split(f"</{plain[1:3]}><{plain[1:3]}>")
            if depth == 1:
                if cell is not None:
                    row.append(closed(*cell))
                row = cell = None
                rows.append((section, [(is_title, (html.unescape(x) if "&" in x else x).strip(), 1, 1) for x in texts]))
            elif cell is not None:
                cell[1].extend([*texts, tail, after or ""])
            continue
        if name is not None and (depth == 1 or name[1] in "Aa"):
            name = name.lower()
            if cell is not None and depth == 1 and name != "table":
                row.append(closed(*cell))
                cell = None
            if name == "td" or name == "th":
                if not closing:
                    if row is None:
                        row = []
                        rows.append((section, row))
                    if after is not None:
                        row.append(closed(name == "th", [tail], attributes))
                    else:
                        cell = name == "th", [tail], attributes
                continue
            if name == "table":
                depth = depth - 1 if closing else depth + 1
                if depth < 0:
                    depth = 0  # a closing tag before any table
                elif depth == 0:
                    break
            else:
                row = None
                if name == "tr":
                    if not closing:
                        row = []
                        rows.append((section, row))
                elif closing:
                    section = ("", 0)
                else:
                    sections += 1
                    section = (name, sections)
        if cell is not None:
            cell[1].append(tail if bare is None else "<" + tail)
            if after is not None:
                if depth == 1:
                    row.append(closed(*cell))
                    cell = None
                else:
                    cell[1].append(after)
    if cell is not None:
        row.append(closed(*cell))
    return rows


def closed(is_title: bool, pieces: list, attributes: str) -> tuple:
    text = "".join(pieces)
    text = (html.unescape(text) if "&" in text else text).strip()
    return (is_title, text, *spans(attributes)) if attributes else (is_title, text, 1, 1)


def spread(rows: list) -> list:
    """Texts of every row by column, spans filled in."""
    if all([c[2] == 1 == c[3] for row in rows for c in row]):
        return [[c[1] for c in row] for row in rows]
    held, out = {}, []  # column -> text from above and the rows it still reaches
    for row in rows:
        line, below = [], {}

        def place(text, down):
            if down > 1:
                below[len(line)] = (text, down - 1)
            held.pop(len(line), None)
            line.append(text)

        for _, text, across, down in row:
            while len(line) in held:
                place(*held[len(line)])
            for _ in range(across):
                place(text, down)
        while held and row:
            place(*held.get(len(line), ("", 1)))
        held.update(below)
        out.append(line)
    return out


def column_titles(rows: list) -> list:
    """Titles from header rows: of the rows that reach over all columns the lowest; others are captions or notes."""
    lines = spread(rows)
    width = max(map(len, lines), default=0)
    return next((line for line in reversed(lines) if len(line) == width), [])


def plain_rows(block: str) -> list:
    """(titles?, texts of cells) of every row of a block that ``PLAIN`` has matched."""
    out = []
    for row in block.split("<tr>")[1:]:
        titles = row.startswith("<th>")
        texts = row[4:row.rindex("</tr>") - 5].split("</th><th>" if titles else "</td><td>")
        if row.count("<") > 2 * len(texts) + 1:
            texts = [STYLES.sub("", x) if "<" in x else x for x in texts]
        if "&" in row:
            texts = [html.unescape(x) if "&" in x else x for x in texts]
        out.append((titles, list(map(str.strip, texts))))
    return out


def plain_table(text: str, header: str) -> tuple | None:
    """``table_rows`` of a document with a plain table; None for any other."""
    found = PLAIN.match(text)
    if found is None or header != "th" and found[1] is None:
        return None
    if header == "th":
        rows = plain_rows(found[3] if found[1] is None else found[1] + found[2])
        lines = [texts for titles, texts in rows if titles]
    else:
        rows, lines = plain_rows(found[2]), [texts for _, texts in plain_rows(found[1])]
    width = max(map(len, lines), default=0)
    return next((x for x in reversed(lines) if len(x) == width), []), [[] if titles else texts for titles, texts in rows]


def table_rows(text: str, header: str) -> tuple:
    """(titles, rows) of a document's first table; rows without cells are empty lists.

    ``header='th'``: rows of ``th`` cells alone have the titles, and all rows of
    the table count. ``header='thead'``: the first table head has the titles,
    the first table body the rows.
    """
    plain = plain_table(text, header)
    if plain is not None:
        return plain
    rows = first_table(text)
    if header == "th":
        titles = column_titles([r for _, r in rows if r and all(c[0] for c in r)])
        return titles, spread([[c for c in r if not c[0]] for _, r in rows])
    head, body = (next((s for s, _ in rows if s[0] == name), None) for name in ("thead", "tbody"))
    titles = column_titles([r for s, r in rows if s == head and r])
    return titles, spread([[c for c in r if not c[0]] for s, r in rows if s == body]) if body else []


def elements(text: str, row_tag: str, fields: list) -> list:
    """Texts of the named children of every ``row_tag`` element; None for absent or empty ones."""
    try:
        roots = [ElementTree.fromstring(text.strip())]
    except ElementTree.ParseError:
        roots = []
        for block in re.findall(rf"(?s)<{row_tag}[\s>].*?</{row_tag}\s*>", text):
            try:
                roots.append(ElementTree.fromstring(block))
            except ElementTree.ParseError:
                continue
    out = []
    for root in roots:
        # a namespace is part of a parsed name
        names = {e.tag for e in root.iter() if isinstance(e.tag, str) and e.tag.endswith("}" + row_tag)} if "xmlns" in text else ()
        for element in (e for name in (row_tag, *names) for e in root.iter(name)):
            texts = {}
            for child in element:
                if isinstance(child.tag, str):  # comments have none
                    texts.setdefault(child.tag.rpartition("}")[2], "".join(child.itertext()) if len(child) else child.text)
            out.append([texts.get(f) or None for f in fields])
    return out
