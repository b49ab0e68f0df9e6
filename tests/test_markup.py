"""The table reader against a model built on the standard library's parser."""

import datetime
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings, strategies as st

from voltide import schemas
from voltide.sources import documents, markup
from voltide.sources.markup import column_titles, elements, first_table, spread, table_rows

DAY = datetime.date(2021, 1, 5)


class Model(HTMLParser):
    """Texts of the cells of the first table; every tag must be closed."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.rows, self.cell = 0, False, [], None
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "table"
        if self.depth == 1 and not self.done:
            if tag == "tr":
                self.rows.append([])
            if tag in ("td", "th"):
                self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.depth == 1 and self.cell is not None:
            self.rows[-1].append((tag == "th", "".join(self.cell).strip()))
            self.cell = None
        if tag == "table":
            self.depth -= 1
            self.done |= self.depth == 0

    def handle_data(self, data):
        if self.cell is not None and getattr(self, "cdata_elem", None) is None:
            self.cell.append(data)


words = st.text(alphabet="ab 0&;<>\n\xa0中\"'/", max_size=8).map(lambda s: s.replace("&", "&amp;").replace("<", "&lt;"))
inline = st.one_of(words, words.map(lambda w: f"<b class='x>y'>{w}</b>"), st.just("<br/>"), st.just("<!-- <td> </table> -->"),
                   st.just("<script>if (1 < 2) '</td><tr>';</script>"), st.just("&nbsp;&infin;"))
attributes = st.sampled_from(["", " align=right", ' title="a > b"', " data-x='</td>'".replace("<", "&lt;")])
inner = st.lists(inline, max_size=3).map("".join)


def table(content):
    cell = st.tuples(st.sampled_from(["td", "th", "TD"]), attributes, content).map(lambda c: f"<{c[0]}{c[1]}>{c[2]}</{c[0]}>")
    row = st.lists(cell, max_size=4).map(lambda cells: f"<tr>{''.join(cells)}</tr>\n")
    return st.lists(row, max_size=4).map(lambda rows: f"<table id=t>{''.join(rows)}</table>")


nested = st.tuples(inner, table(inner), inner).map("".join)
pages = st.tuples(inner, table(st.one_of(inner, nested)), inner, table(inner)).map("".join)


@settings(max_examples=300, deadline=None)
@given(pages)
def test_cells_are_those_of_a_full_parser(page):
    want = Model(page).rows
    assert [[(c[0], c[1]) for c in row] for _, row in first_table(page)] == want


@settings(max_examples=100, deadline=None)
@given(pages)
def test_missing_closing_tags_change_nothing(page):
    bare = page
    for tag in ("td", "th", "TD", "tr"):
        bare = bare.replace(f"</{tag}>", "")
    if "<script" in page or "</td" in page.replace("</td>", ""):
        return
    assert first_table(bare) == first_table(page)


def test_header_rows_of_several_widths():
    head = "<table><tr><th colspan=4>caption</th></tr><tr><th rowspan='2'>a</th><th colspan=2>group</th><th rowspan=2>d</th></tr><tr><th>b</th><th>c</th></tr>"
    titles, rows = table_rows(head + "<tr><th>unit: lots</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table>", "th")
    assert titles == ["a", "b", "c", "d"] and [r for r in rows if r] == [["1", "2", "3", "4"]]
    assert column_titles([]) == []


def test_spans_fill_their_columns_and_rows():
    cell = lambda text, across=1, down=1: (False, text, across, down)
    rows = [[cell("x", 2), cell("y", 1, 3), cell("z", 1, 2)], [cell("a"), cell("b")], [], [cell("c")], [cell("d"), cell("e"), cell("f")]]
    assert spread(rows) == [["x", "x", "y", "z"], ["a", "b", "y", "z"], [], ["c", "", "y"], ["d", "e", "f"]]
    assert spread([[cell("a"), cell("p", 1, 2)], [cell("w", 3)]]) == [["a", "p"], ["w", "w", "w"]]
    _, rows = table_rows("<table><tr><td rowspan=99999999999>k<td colspan=0>1<tr><td>2<tr><td>3</table>", "th")
    assert rows == [["k", "1"], ["k", "2"], ["k", "3"]]


def test_sections():
    doc = ("<table><thead><tr><td>t</td></tr></thead><tfoot><tr><td>f</td></tr></tfoot><tbody><tr></tr><tr><td>1</td></tr></tbody>"
           "<tbody><tr><td>2</td></tr></tbody></table>")
    assert table_rows(doc, "thead") == (["t"], [[], ["1"]])
    assert table_rows(doc.replace("<tbody>", "").replace("</tbody>", ""), "thead") == (["t"], [])


@pytest.mark.parametrize("doc", ["<table><tr><td a=\"" + "<td x='" * 20000, "<table>" * 20000, "<!--" * 20000, "<" * 50000, "<script " * 5000])
def test_broken_documents_cost_their_length(doc):
    start = time.process_time()
    table_rows(doc, "th")
    assert time.process_time() - start < 5


def payloads(spark, *texts):
    return spark.createDataFrame([("X", "k", DAY, t) for t in texts], schemas.RAW_PAYLOADS)


def test_records_carry_one_cell_of_the_row_before(spark):
    n = 30_000
    rows = "".join(f"<tr><td>{i}</td><td>v{i}</td></tr>" if i % 3 else "<tr></tr>" for i in range(n))
    doc = f"<table><thead><tr><td>id</td><td>new</td></tr></thead><tbody>{rows}</tbody></table>"
    found = documents.html_records(payloads(spark, doc, None, "", "<table>"), {"k": ("id",), "v": ("old", "new"), "w": ("none",)}, carry="k")
    assert found.columns == ["exchange", "trade_date", "pos", "k", "v", "w", "carried"]
    got = sorted(found.collect(), key=lambda r: r.pos)
    want = [i for i in range(n) if i % 3]
    assert [(r.pos, r.k, r.v, r.w, r.carried) for r in got] == [(i, str(i), f"v{i}", None, str(i - 1) if (i - 1) % 3 else None) for i in want]


def test_short_rows_and_other_titles(spark):
    doc = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr><tr><td>2</td><td>3</td><td>4</td></tr></table>"
    got = documents.html_records(payloads(spark, doc), {"a": ("a",), "b": ("b",)}, header="th").collect()
    assert [(r.pos, r.a, r.b) for r in got] == [(1, "1", None), (2, "2", "3")]
    assert documents.html_records(payloads(spark), {"a": ("a",)}).count() == 0


def test_elements_of_xml():
    doc = '\n<?xml version="1.0" encoding="GBK"?><a xmlns="u:x"><b><doc><!-- c --><t>1 <i>x</i></t><u/></doc><doc><t>2</t><t>3</t></doc></b></a>'
    assert elements(doc, "doc", ["t", "u", "v"]) == [["1 x", None, None], ["2", None, None]]
    broken = "<a><doc><t>1</t></doc><doc><t>2&nbsp;</t></doc><doc><t>5</t></doc>"
    assert elements(broken, "doc", ["t"]) == [["1"], ["5"]] and elements("", "doc", ["t"]) == [] == elements("<docs/>", "doc", ["t"])
    assert elements("<doc><t>9 &amp; &#60;</t></doc>", "doc", ["t"]) == [["9 & <"]]


def test_plain_rows_are_one_match():
    from voltide.sources.markup import TAGS, table_rows

    head, plain = "<tr><th>a</th><th>b</th></tr>", "<tr><td>x &amp; y</td><td> 1 </td></tr>\n"
    assert len(list(TAGS.finditer(plain))) == 1 and len(list(TAGS.finditer(head))) == 1
    nested = "<tr><td>o<table>" + plain + "z</td></table>q</td><td>2</td></tr>"
    assert table_rows(f"<table>{head}{plain}{nested}<tr><td>open" + plain + "</table>", "th") == (
        ["a", "b"], [[], ["x & y", "1"], ["ox & y 1 \nzq", "2"], ["open"], ["x & y", "1"]])


def test_plain_tables_are_one_match_with_the_rows_of_the_general_way(monkeypatch):
    head, rows = "<thead><tr><td>a</td><td> b&amp;c</td></tr>\n</thead>", "<tr><td>1</td><td><b>2</b>&nbsp;</td></tr>\n<tr><td>x</td><td></td></tr>"
    titled = "<tr><th>note</th></tr><tr><th>t</th><th>u</th></tr>"
    plain = [f"<TABLE id='>'>{head}<tbody>{rows}</tbody></TABLE><table>", f"<p>q</p><table>\n{titled}{rows}</table>", "<table></table>",
             f"<table>{titled}<tr><td>1</td></tr>{rows}</table><table><tr><td>9</td></tr></table>"]
    others = [plain[1].replace("</td></tr>", "</tr>"), f"<!--{plain[1]}-->{plain[3]}", f"<script>{plain[1]}</script>{plain[3]}", plain[1][:-8],
              plain[1].replace("<td>x", "<td colspan=2>x"), plain[1].replace("x", plain[3]), plain[1].replace("x", "<"), f"<a t='{plain[3]}'>{plain[1]}"]
    for header in ("th", "thead"):
        found = [(markup.plain_table(x, header), markup.table_rows(x, header)) for x in plain + others]
        with monkeypatch.context() as m:
            m.setattr(markup, "plain_table", lambda *_: None)
            assert [markup.table_rows(x, header) for x in plain + others] == [f[1] for f in found]
        assert all(f[0] is None for f in found[len(plain):])
        assert all(f[0] is not None for f in found[:1 if header == "thead" else len(plain)])
    assert markup.table_rows(plain[0], "thead") == (["a", "b&c"], [["1", "2"], ["x", ""]])
    assert markup.table_rows(plain[3], "th") == (["t", "u"], [[], [], ["1"], ["1", "2"], ["x", ""]])
