"""HTML rendering against a plain second renderer over generated pages, and its bounds."""

import html as entities
import random
import time

import pytest

from siltbed.llm import html_text


@pytest.mark.parametrize("html,text", [
    ("<script>if(a<b){ // don't\n}</script><p>Hello</p><p>World</p>", "Hello\n\nWorld"),
    ("<title>a <b don't</title><div hidden>secret</div><p>Hello</p>", "Hello"),
    ("<style>a>b{content:'<p>'}</style>x<textarea><b>y</textarea >z", "x <b>y z"),
    ("<script>'</scripty><p>no'</script\n x>yes", "yes"), ("a<plaintext>b<c>", "a\n\nb<c>"),
    ("<p style='visibility:hidden'>a <b style='visibility: visible'>b</b> c</p>", "b"),
    ("<ol style='visibility:hidden'><li>a<li style='visibility:visible'>b</ol>", "2. b"),
    ("<div hidden style='display:block'>a</div><div style='color:red;display:none'>b</div>", "a"),
    ("<form><input type=submit value=Go><input type=hidden value=x><input value=v><input type=checkbox value=y><input placeholder=Name><button>OK</button></form>", "Go v Name OK"),
    ("<details><summary>s</summary>rest</details><details open><summary>t</summary>more</details><dialog>d</dialog>", "s\nt\nmore"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>bbb<td>c</table>", "wide    z\na  bbb  c"),
    ("<table><tr><td rowspan=2>r<td>one<tr><td>two<tr><td>x<td>y</table>", "r  one\n   two\nx  y"),
    ("<table><tr><td><ul><li>a<li>b</ul><td>c</table>", "- a  c\n- b"),
    ("<table><caption>cap</caption><tr><td>a<table><tr><td>in</table><td>b</table>", "cap\na   b\n\nin"),
    ("<img alt='it&#39;s'><img alt=\"'q'\">", "it's'q'"),
])
def test_rules(html, text):
    assert html_text.extract(html) == text


def pages(rng):
    """(html, text) of a page: its text comes from the plan of the page, not from its html."""
    def word():
        return rng.choice(["a", "bb", "ccc", "dé", "x<y", "&", "it's", '"q"', "</p>", "\U0001F600"]) + rng.choice(["", "1", "22"])

    def inline(n):
        made, seen = [], []
        for _ in range(n):
            w = word()
            e = entities.escape(w, quote=False)
            k = rng.randrange(9)
            if k == 0:
                made.append(f"<span hidden>{e}</span>")
            elif k == 1:
                made.append("<script>var x='<p>" + rng.choice(["a<b", "don't", "<!--", '"']) + "'</script>")
            elif k == 2:
                made.append(f"<!-- {e} <b> -->")
            else:
                made.append(f"<{t}>{e}</{t}>" if (t := rng.choice(["b", "i", "span", ""])) else e)
                seen.append(w)
        return rng.choice([" ", "\n  ", "\t"]).join(made), " ".join(seen)

    def listing(depth):
        ordered, out, lines = rng.random() < 0.5, [], []
        first = rng.choice([1, 1, 7])
        for k in range(rng.randint(1, 4)):
            h, t = inline(rng.randint(1, 3))
            inner_h, inner = listing(depth + 1) if depth < 3 and rng.random() < 0.4 else ("", [])
            out.append(f"<li>{h}{inner_h}" + rng.choice(["</li>", ""]))
            mark = f"{first + k}. " if ordered else "- "
            body = ([t] if t else []) + inner
            lines += [(mark if i == 0 else " " * len(mark)) + x for i, x in enumerate(body)]
        tag = "ol" if ordered else "ul"
        return f"<{tag}{f' start={first}' if ordered and first > 1 else ''}>" + "".join(out) + f"</{tag}>", lines

    def table():
        taken, cells, out = {}, [], []
        for r in range(rng.randint(1, 5)):
            out.append("<tr>")
            c = 0
            for _ in range(rng.randint(1, 4)):
                while (r, c) in taken:
                    c += 1
                across, down, (h, t) = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3]), inline(rng.randint(0, 2))
                tag = rng.choice(["td", "th"])
                out.append(f"<{tag}{f' colspan={across}' if across > 1 else ''}{f' rowspan={down}' if down > 1 else ''}>{h}" + rng.choice([f"</{tag}>", ""]))
                for y in range(r, r + down):
                    for x in range(c, c + across):
                        taken[y, x] = True
                cells.append((r, c, across, t))
                c += across
            out.append(rng.choice(["</tr>", ""]))
        width = {}
        for _, c, across, t in cells:
            if across == 1:
                width[c] = max(width.get(c, 0), len(t))
        lines = []
        for r in range(len(out)):
            line = ""
            for _, c, _, t in (x for x in cells if x[0] == r and x[3]):
                start = sum(w + 2 for k, w in width.items() if k < c and w)
                line = line.ljust(max(start, len(line) + 2 if line else 0)) + t
            if line:
                lines.append(line)
        return "<table>" + "".join(out) + "</table>", lines

    made, blocks = [], []
    for _ in range(rng.randint(1, 6)):
        kind = rng.randrange(6)
        if kind < 2:
            h, t = inline(rng.randint(0, 6))
            tag = rng.choice(["p", "h2", "blockquote"])
            made.append(f"<{tag}>{h}</{tag}>")
            blocks.append([t] if t else [])
        elif kind == 2:
            h, lines = listing(0)
            made.append(h)
            blocks.append(lines)
        elif kind == 3:
            h, lines = table()
            made.append(h)
            blocks.append(lines)
        elif kind == 4:
            lines = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))]
            made.append("<pre>" + "\n".join(entities.escape(x, quote=False) for x in lines) + "</pre>")
            blocks.append(lines)
        else:
            made.append("<div style='x:y;display:none'><table><tr><td>no<p>no</table></div>")
    return "<html><head><title>t<b</title></head><body>" + rng.choice(["", "\n"]).join(made), "\n\n".join("\n".join(x) for x in blocks if x)


def test_generated_pages_equal_a_second_renderer():
    rng = random.Random(3)
    for _ in range(1500):
        html, text = pages(rng)
        assert html_text.extract(html) == text, html


@pytest.mark.parametrize("unit,tail", [
    ("</b></i>", ""), ("<b></td>", ""), ("<div>", "x"), ("<p><b>", "x"), ("<ul><li>x", ""), ("<table><tr><td>x", ""), ("<tr><td rowspan=9999 colspan=999>x", ""),
    ("<td><div>", ""), ("<dl><dd>y", ""), ("<script>'", ""), ("<a b='", ""), ("<!--", ""), ("<title>", ""), ("<table><tr><td>" + "w" * 70 + "<td>x</table>", ""),
])
def test_time_and_size_grow_with_the_html(unit, tail):
    def seconds(n):
        source = "<table><tr><td>" + unit * (n // len(unit)) + tail
        at = time.process_time()
        text = html_text.extract(source)
        assert len(text) <= 40 * len(source) + 200
        return time.process_time() - at

    seconds(10_000)
    small, large = seconds(100_000), seconds(1_000_000)
    assert large < 30 * max(small, 0.05)


def test_a_wide_table_is_not_padded_to_its_widest_cell():
    source = "<table><tr><td>" + "w" * 60_000 + "<td>x" + "<tr><td>a<td>b" * 600 + "</table>"
    assert len(html_text.extract(source)) < 70_000
    long = "<table>" + "<tr><td>cell<td>" + "y" * 40 + "<td>z</tr>"
    assert html_text.extract(long * 150_000 + "</table>").count("z") == 150_000  # 7 MB and more
