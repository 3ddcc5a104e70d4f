"""Notes as HTML, against a plain version that walks over the lines and recurses into lists."""

import random
import re

from colloquy.sources import pages as P


def plain_inline(t):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = t.replace(a, b)

    def styled(x):
        x = re.sub(r"\[([^\[\]]*)\]\(([^()\s]*)\)", r'<a href="\2">\1</a>', x)
        x = re.sub(r"\*\*(\S(?:[^*]*[^*\s])?)\*\*", r"<strong>\1</strong>", x)
        return re.sub(r"(?<![\w*])\*([^*\s](?:[^*]*[^*\s])?)\*(?![\w*])", r"<em>\1</em>", x)

    out, parts = "", t.split("`")
    for i, x in enumerate(parts):
        if i % 2 and i + 1 < len(parts):
            out += f"<code>{x}</code>"
        else:
            out += ("`" if i % 2 else "") + styled(x)
    return out


ITEM = re.compile(r"^( *)([-*+]|\d{1,9}[.)]) +(.*)$")


def plain_list(items):
    """items: (depth, mark, html). A list takes items of its level; deeper ones make a list within the last."""

    def at(level, i):
        out, mark = "", None
        while i < len(items) and items[i][0] >= level:
            depth, own, html = items[i]
            if mark is None:
                out += f"<{own}><li>{html}"
            elif depth > level:
                inner, i = at(level + 1, i)
                out += inner
                continue
            elif own == mark:
                out += f"</li><li>{html}"
            else:
                out += f"</li></{mark}><{own}><li>{html}"
            mark = own
            i += 1
        return out + f"</li></{mark}>", i

    return at(0, 0)[0]


def plain_page(work, note):
    lines = note.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    blocks, i, code = [], 0, False
    open_kind = None
    last_real = None
    for t in lines:
        if re.match(r"^ {0,3}```", t):
            code = not code
            if code:
                blocks.append(["code", []])
            open_kind = last_real = "code"
            continue
        if code:
            blocks[-1][1].append(t)
            continue
        if not t.strip(" "):
            open_kind = last_real = "blank"
            continue
        if re.match(r"^#{1,6}(?: |$)", t):
            level = len(re.match("^#+", t)[0])
            blocks.append(["heading", [(level, re.match(r"^#+ *(.*?) *#* *$", t)[1])]])
            open_kind = last_real = "heading"
            continue
        if re.match(r"^ {0,3}(?:(?:- *){3,}|(?:\* *){3,}|(?:_ *){3,})$", t):
            blocks.append(["rule", []])
            open_kind = last_real = "rule"
            continue
        if re.match(r"^ {0,3}>", t):
            depth = re.match(r"^[ >]*", t)[0].count(">")
            body = re.sub(r"^[ >]*", "", t)
            if open_kind == "quote" and blocks[-1][1][0] == depth:
                blocks[-1][1][1].append(body)
            else:
                blocks.append(["quote", [depth, [body]]])
            open_kind = last_real = "quote"
            continue
        if re.match(r"^ *\|.*\| *$", t):
            if open_kind == "table":
                blocks[-1][1].append(t.strip(" "))
            else:
                blocks.append(["table", [t.strip(" ")]])
            open_kind = last_real = "table"
            continue
        if m := ITEM.match(t):
            item = [len(m[1]) // 2, "ol" if re.search("[0-9]", m[2]) else "ul", [m[3]]]
            if open_kind == "list":
                blocks[-1][1].append(item)
            else:
                blocks.append(["list", [item]])
            open_kind = last_real = "list"
            continue
        if last_real == "list":
            blocks[-1][1][-1][2].append(t.strip(" "))
        elif last_real == "quote":
            blocks[-1][1][1].append(t.strip(" "))
        elif open_kind == "text":
            blocks[-1][1].append(t.strip(" "))
        else:
            blocks.append(["text", [t.strip(" ")]])
            open_kind = "text"
    seen, toc, out, title = {}, [], [], None
    for kind, v in blocks:
        if kind == "heading":
            level, text = v[0]
            name = re.sub(r"[\W_]+", "-", text.lower()).strip("-") or "section"
            seen[name] = seen.get(name, 0) + 1
            anchor = name if seen[name] == 1 else f"{name}--{seen[name]}"
            title = text if title is None else title
            out.append(f'<h{level} id="{anchor}">{plain_inline(text)}</h{level}>')
            if level <= 2:
                toc.append((level - 1, "ul", f'<a href="#{anchor}">{plain_inline(text)}</a>'))
        elif kind == "rule":
            out.append("<hr>")
        elif kind == "quote":
            out.append("<blockquote>" * v[0] + "<p>" + plain_inline("\n".join(v[1])) + "</p>" + "</blockquote>" * v[0])
        elif kind == "code":
            if v:
                body = "\n".join(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
                out.append(f"<pre><code>{body}\n</code></pre>")
        elif kind == "table":
            cells = lambda line, tag: "<tr>" + "".join(f"<{tag}>{plain_inline(c.strip(' '))}</{tag}>" for c in re.sub(r"^\||\|$", "", line).split("|")) + "</tr>"
            if len(v) > 1 and re.fullmatch(r":?-+:?(?:\|:?-+:?)*", re.sub(r"^\||\|$", "", re.sub(r"\s", "", v[1]))):
                out.append("<table><thead>" + cells(v[0], "th") + "</thead><tbody>" + "".join(cells(x, "td") for x in v[2:]) + "</tbody></table>")
            else:
                out.append("<table><tbody>" + "".join(cells(x, "td") for x in v) + "</tbody></table>")
        elif kind == "list":
            out.append(plain_list([(d, m, plain_inline("\n".join(t))) for d, m, t in v]))
        else:
            out.append("<p>" + plain_inline("\n".join(v)) + "</p>")
    title = work if title is None else title
    esc = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    nav = f'<nav id="TOC">{plain_list(toc)}</nav>\n' if toc else ""
    return title, f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{esc}</title></head><body>\n{nav}' + "\n".join(out) + "\n</body></html>\n"


def random_note(rng):
    words = ["alpha", "*em*", "**strong words**", "`co<de`", "[a](u?x=1)", "5 < 6 & \"q\"", "`", "*", "тема", "a|b"]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 5)))
    makers = [
        lambda: "#" * rng.randrange(1, 5) + " " + rng.choice(["Title", "Тема 1", "Title", "!?", "a *b*", "Title ##", ""]), lambda: "", lambda: "", lambda: rng.choice(["---", "***", " _ _ _"]), lambda: rng.choice([">", "> >", ">>"]) + " " + text(),
        lambda: " " * rng.randrange(0, 7) + rng.choice(["-", "*", "1.", "12)"]) + " " + text(), lambda: " " * rng.randrange(0, 4) + "- " + text(), lambda: "| " + " | ".join(text().replace("|", "/") for _ in range(2)) + " |", lambda: "|---|:-:|",
        lambda: "```" + rng.choice(["", "py"]), text, text, lambda: "  " + text(),
    ]
    return "\n".join(rng.choice(makers)() for _ in range(rng.randrange(0, 30))) + rng.choice(["", "\n"])


def test_against_a_plain_version(spark):
    rng = random.Random(12)
    notes = {f"w{i}": random_note(rng) for i in range(250)} | {"empty": "", "tail": "text\n```\nopen <code>\n\n# no heading", "deep": "- a\n        - b\n    - c\n1. d\n  - e\n- f\n- g"}
    df = spark.createDataFrame(list(notes.items()), "work_id string, note string")
    got = {r["work_id"]: (r["title"], r["html"]) for r in P.note_pages(df).collect()}
    for work, note in notes.items():
        assert got[work] == plain_page(work, note), note


def test_contents_have_unique_anchors(spark):
    note = "# A\n## A\n### deep\n## a\n# a 2\n## !\n## B\n"
    rows = P.headings(P.classified(P.lines_of(spark.createDataFrame([("w", note)], "doc_id string, text string"))))
    anchors = [r["anchor"] for r in rows.orderBy("block").collect()]
    assert anchors == ["a", "a--2", "deep", "a--3", "a-2", "section", "b"]
    html = P.note_pages(spark.createDataFrame([("w", note), (None, None)], "work_id string, note string"))
    toc = html.filter("work_id = 'w'").first()["html"].split("<nav id=\"TOC\">")[1].split("</nav>")[0]
    assert toc == '<ul><li><a href="#a">A</a><ul><li><a href="#a--2">A</a></li><li><a href="#a--3">a</a></li></ul></li><li><a href="#a-2">a 2</a><ul><li><a href="#section">!</a></li><li><a href="#b">B</a></li></ul></li></ul>'
