import random
import time

import pytest

from tallyforge.llm import html_text as H


def text(source):
    return H.extract(source)[1]


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a<div>b</div>c</div>d", "a\nb\nc\nd"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<b>a</b> <i>b</i>c", "a bc"),
        ("a <b> b</b>", "a b"),
        ("<h1>T</h1>x<ul><li>one<li>two<ul><li>deep</ul><li>three</ul>y", "T\n\nx\n\n- one\n- two\n  - deep\n- three\n\ny"),
        ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>", "Name       N\nlong name  1\nx          22"),
        ("<table><td>a<td>b<tr><td colspan=2>wide<tr><td rowspan=2>r<td>1<tr><td>2</table>", "a  b\nwide\nr  1\n   2"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("<table><caption>cap</caption><tr><td><table><tr><td>in<td>ner</table><td>o</table>", "cap\nin  ner  o"),
        ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"),
        ("<script>var t='</p>';</script>x<style>p{}</style>", "x"),
        ("<p hidden>no</p><p style='Display : none'>no</p><p style=\"visibility:hidden\">no</p>yes", "yes"),
        ("<details>no<summary>s</summary></details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<!-- c --><!doctype html><?pi?>x<!-->y", "xy"),
        ("&lt;b&gt; &amp; &copy; &nbsp;x", "<b> & ©  x"),
        ("<a title='a > b'>x</a>", "x"),
        ("<head><title>T &amp; t</title><p>body", "body"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("<textarea> a <b> </textarea>", " a <b>"),
        ("</p></div></table>x</b>", "x"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<p>a</p>\n\n<p>b</p>", "a\n\nb"),
        ("<template>no</template><noscript>no</noscript><svg>no<title>no</title><defs><text>no</text></defs></svg>yes", "yes"),
        ("<title>T</title>a<svg><path d='x'/><g><text>hi <tspan>there</tspan></text><text>two</text></g></svg>b", "a\nhi there\ntwo\nb"),
        ("<svg><defs/><text>x</text><foreignObject><p>in</p></foreignObject><g href=a/><text>y</svg>z", "x\n\nin\n\ny\nz"),
        ("<svg><g>no<p>out</p>side", "out\n\nside"),
        ("<table><tr><td colspan=2>wide wide wide wide<td>z<tr><td>a<td>b<td>c</table>", "wide wide wide wide  z\na  b                 c"),
        ("<table><tr><td>a<td colspan=3>b<td>c<tr><td>d<td>e<td>f<td>g<td>h</table>", "a  b        c\nd  e  f  g  h"),
        ("<p style='visibility:hidden'>no <b style='visibility:visible'>yes <i style='visibility:inherit'>too</i></b> no</p>", "yes too"),
        ("<div style='display:none'><b style='display:block;visibility:visible'>no</b></div>x", "x"),
        ("<p hidden style='display:block'>shown</p><p hidden>no</p>", "shown"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
    ],
)
def test_layout(source, want):
    assert text(source) == want


def test_title_and_null(spark):
    rows = [(1, "u", "<title> a\n b </title><p>x"), (2, None, None), (3, "v", ""), (None, "w", "<p>y"), (1, "u", "<title> a\n b </title><p>x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS title")
    got = [tuple(r) for r in H.extract_pages(table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "u", "a b", "x"), (2, None, None, None), (3, "v", "", ""), (None, "w", "", "y"), (1, "u", "a b", "x")]))
    assert H.extract_pages(table.limit(0)).count() == 0


def test_deep_and_long_pages():
    assert text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert text("<b>" * 5_000 + "x" + "<ul><li>" * 500 + "y").split()[-1] == "y"
    assert text("<p>word</p>" * 20_000).count("word") == 20_000
    for opened in ("<div>", "<p><button><div>", "<ul><li>", "<b><p>", "<blockquote>", "<svg><g>"):
        began = time.time()
        assert text(opened * 100_000 + "<div>x").split()[-1] == "x"
        assert time.time() - began < 10
    assert text("<" * 50_000) == "<" * 50_000


def test_every_visible_word_is_there_in_order():
    rng = random.Random(8)
    tags = ["p", "div", "b", "li", "ul", "table", "tr", "td", "span", "h2", "a", "section", "pre", "dd", "blockquote"]
    for n in range(600):
        parts, words = [], []
        some = tags if n % 2 else [t for t in tags if t[0] != "t"]
        for i in range(rng.randint(1, 30)):
            kind = rng.random()
            if kind < 0.45:
                words.append(f"w{i}")
                parts.append(f" w{i} ")
            elif kind < 0.8:
                parts.append(f"<{rng.choice(some)}>")
            else:
                parts.append(f"</{rng.choice(some)}>")
        got = [w for w in text("".join(parts)).split() if w[0] == "w"]
        assert sorted(got) == sorted(words)  # a table's cells may stand beside each other
        assert n % 2 or got == words


class Page:
    """A random page as a tree, its source with end tags left out where they may be, and its
    lines by recursion over the tree."""

    INLINE, BLOCKS = ("b", "span", "a", "i"), ("div", "section", "h2", "article")

    def __init__(self, rng):
        self.rng, self.n = rng, 0

    def tree(self, depth, inline=False):
        kinds = ["word"] * 4 + ["br", "hidden", "invisible", "visible"] + ["inline"] * 2 + ([] if inline else ["block", "p", "list", "table"])
        return [self.node(self.rng.choice(kinds), depth, inline) for _ in range(self.rng.randint(1, 4))]

    def node(self, kind, depth, inline):
        self.n += 1
        if kind in ("word", "br") or depth == 0:
            return ("br",) if kind == "br" else ("word", f"w{self.n}")
        if kind == "list":
            return ("list", [self.tree(depth - 1) for _ in range(self.rng.randint(1, 3))])
        if kind == "table":
            return ("table", [[self.node("word", 0, True)[1] for _ in range(self.rng.randint(1, 3))] for _ in range(self.rng.randint(1, 3))])
        tag = self.rng.choice(self.BLOCKS) if kind == "block" else "p" if kind == "p" else self.rng.choice(self.INLINE)
        return (kind, tag, self.tree(depth - 1, inline or kind != "block"))

    def source(self, nodes):
        out = ""
        for x in nodes:
            end = lambda tag: self.rng.choice((f"</{tag}>", f"</{tag.upper()} >"))
            if x[0] == "word":
                out += f" {x[1]}\n"
            elif x[0] == "br":
                out += self.rng.choice(("<br>", "<BR/>", "</br>"))
            elif x[0] == "list":
                out += "<ul>" + "".join(f"<li>{self.source(i)}" + self.rng.choice(("", "</li>")) for i in x[1]) + end("ul")
            elif x[0] == "table":
                cells = ("".join(f"<td> {c}" + self.rng.choice(("", "</td>")) for c in row) for row in x[1])
                out += "<table>" + "".join(f"<tr>{c}" + self.rng.choice(("", "</tr>")) for c in cells) + end("table")
            else:
                style = {"hidden": " style='display:none'", "invisible": " style=visibility:hidden", "visible": ' STYLE="visibility : visible"'}.get(x[0], "")
                out += f"<{x[1]}{style}>{self.source(x[2])}" + end(x[1])
        return out

    def lines(self, nodes, seen=True):
        """Words, with None where a line ends."""
        out = []
        for x in nodes:
            if x[0] == "word":
                out += [x[1]] if seen else []
            elif x[0] == "br":
                out += [None] if seen else []
            elif x[0] == "list":
                out += [None] + [y for item in x[1] for y in (*(["-"] if seen else []), *self.lines(item, seen), None)]
            elif x[0] == "table":
                out += [None] + ([y for row in x[1] for y in (*row, None)] if seen else [])
            elif x[0] != "hidden":
                inner = self.lines(x[2], {"invisible": False, "visible": True}.get(x[0], seen))
                out += [None, *inner, None] if x[0] in ("block", "p") else inner
        return out


def test_lines_of_random_pages_by_brute_force():
    rng = random.Random(11)
    for _ in range(3_000):
        page = Page(rng)
        tree = page.tree(4)
        lines, line = [], []
        for w in [*page.lines(tree), None]:
            if w is not None:
                line.append(w)
                continue
            # a mark stands before the first text of its item, or nowhere
            lines += [line] if any(x != "-" for x in line) else []
            line = [] if any(x != "-" for x in line) else line
        want = [[x for x in line if x != "-"] for line in lines]
        got = [[w for w in x.split() if w != "-"] for x in text(page.source(tree)).split("\n")]
        assert [x for x in got if x] == want, page.source(tree)


def outside_tags(source):
    """Characters outside tags, by the tokenizer states of the HTML standard, one at a time."""
    out, state, quote, begin = [], "data", "", 0
    for i, c in enumerate(source):
        space = c in "\t\n\f\r "
        if state == "data":
            if c == "<" and source[i + 1 : i + 3].lstrip("/")[:1].isalpha():
                state, begin = "name of tag", i
            else:
                out.append(c)
        elif state == "quoted":
            state = "before name" if c == quote else "quoted"
        elif c == "/" and i == begin + 1:
            pass
        elif c == ">":
            state = "data"
        elif state == "before value" and space:
            pass
        elif state == "before value":
            state, quote = ("quoted", c) if c in "\"'" else ("unquoted", "")
        elif state == "unquoted":
            state = "before name" if space else "unquoted"
        elif c == "/":
            state = "before name"
        elif space:
            state = "after name" if state in ("name", "after name") else "before name"
        elif c == "=" and state in ("name", "after name"):
            state = "before value"
        elif state != "name of tag":
            state = "name"
    return "".join(out)


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p title=it's>Hello, <b>don't</b> lose this", "Hello, don't lose this"),
        ('<a href="x"">link text</a> middle <a href="y">two', "link text middle two"),
        ("<a b'>x</a> 'y' <a c = 'd>e' f>z", "x 'y' z"),
        ('<a b="c>d"hidden>x</a>y', "y"),
        ("<a =\"x'>1</a> it's", "1 it's"),
        ("<script>no</script a='>'>x", "x"),
    ],
)
def test_stray_quotes(source, want):
    assert text(source) == want


def test_tags_end_where_the_states_say():
    rng = random.Random(9)
    pieces = ["<b", "<i ", "</b", "x", "y", '"', "'", "=", " ", "/", ">", ">", "\n"]
    for _ in range(20_000):
        source = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert "".join(text(source).split()) == "".join(outside_tags(source).split()), source
    assert text("<b a='" + "\"" * 200_000) == "" and text("<b " + "'=" * 100_000 + ">x") == "x"


@pytest.mark.parametrize(
    "style, seen",
    [
        ("backface-visibility:hidden", True),
        ("--my-display:none; x-visibility : hidden", True),
        ("background:url(a;display:none)", True),
        ("content:';display:none;'", True),
        ("display:none;display:block", True),
        ("display:block!important;display:none", True),
        ("/* display:none; */ color:red", True),
        ("color:red;display:none", False),
        ("display:none;display:nonsense", False),
        ("DISPLAY : NONE ! important ; display:block", False),
        ("visibility/**/:collapse", False),
        ("", True),
    ],
)
def test_only_the_properties_display_and_visibility_hide(style, seen):
    assert text(f'a <span style="{style}">b</span> c') == ("a b c" if seen else "a c")


def test_formulas_and_maps_are_visible():
    assert text("<map name=m><p>label</p><area alt=no></map>x") == "label\n\nx"
    assert text("<math><semantics><mi>E</mi><mo>=</mo><annotation encoding='application/x-tex'>no</annotation></semantics></math> y") == "E= y"
