"""One small export of each platform, and files that are broken."""

import io
import random
import re
import time
import zipfile

import pytest

from textloom.plans import kernels
from textloom.plans.kernels import SAMPLES
from textloom.sources import dom, importers


@pytest.mark.parametrize("platform", sorted(SAMPLES))
def test_samples(platform):
    content = SAMPLES[platform].replace("{{", "{").replace("}}", "}").replace("{}", "7") if platform != "gemini_json" else SAMPLES[platform].format(7)
    assert [(m["role"], m["content"]) for m in importers.importer(platform)(content.encode())] == [("user", "Frage 7"), ("model", "Antwort")]


def test_unknown_platform_is_an_error():
    with pytest.raises(ValueError):
        importers.importer("nowhere")


def test_configs_are_complete():
    for cfg in importers.CONFIGS.values():
        cfg.check()


def test_markdown_rendering():
    root = dom.parse("<div><h2>T</h2><p>a <b>b</b></p><ul><li>x</li><li><p>y</p></li></ul><table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table></div>")
    assert dom.markdown(root) == "## T\na **b**\n\n\n  * x\n  * y\n\n| h |\n| --- |\n| 1 |".replace("\n\n\n", "\n\n")


def recursive_markdown(node, links, fences):
    """The rules of an element, one inside the other."""
    def inner(n):
        return "".join(c if isinstance(c, str) else recursive_markdown(c, links, fences) for c in n.children)

    tag, wrap, head = node.tag, {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}, {"h2": "##", "h3": "###", "h4": "####"}
    if tag in head:
        return f"\n{head[tag]} {inner(node)}\n"
    if tag in wrap:
        return wrap[tag] + inner(node) + wrap[tag]
    if tag == "hr":
        return "\n\n---\n\n"
    if tag in ("ul", "ol"):
        items = [c for c in node.children if isinstance(c, dom.Node) and c.tag == "li"]
        return "\n" + "\n".join("  * " + inner(i).strip() for i in items) + "\n" if items else inner(node)
    if tag == "pre":
        code = node.first("code")
        name = next((c.removeprefix("language-") for c in (code.classes if code else []) if c.startswith("language-")), "") if fences else ""
        return f"\n```{name}\n{''.join(node.strings())}\n```\n"
    if tag == "table" and (heads := [h.text("") for h in node.select("th")]):
        rows = [[d.text("") for d in r.select("td")] for r in node.select("tr")]
        return f"\n\n| {' | '.join(heads)} |\n| {' | '.join(['---'] * len(heads))} |\n" + "".join(f"| {' | '.join(r)} |\n" for r in rows if r) + "\n"
    if tag == "p":
        return inner(node) + "\n\n"
    if tag == "a" and links:
        label = inner(node).strip()
        if "citation" in node.attrs.get("class", "") or len(label) < 3:
            return ""
        return f"[{label}]({node.attrs['href']})" if node.attrs.get("href") else label
    return inner(node)


def test_markdown_of_random_trees_follows_the_rules():
    rng = random.Random(4)
    bits = [f"<{t}>" for t in "h2 b code hr ul ol li li pre table tr td th p a div".split()] + ["<a href=u>"] * 3 + ['<a class="citation" href=u>', '<code class="language-py">']
    bits += [f"</{t}>" for t in "h2 b code ul ol li pre table tr td th p a a div".split()] + ["x", "ab", "lang", " ", "\n", " \n\n\n\n", "\u00a0", " y "] * 3
    for _ in range(4000):
        root = dom.parse("".join(rng.choices(bits, k=rng.randrange(1, 40))))
        for links, fences in ((False, False), (True, False), (True, True)):
            assert dom._render(root, links, fences) == recursive_markdown(root, links, fences)


@pytest.mark.parametrize("name", ["A30_html_to_markdown", "A31_rich_markdown", "A32_link_markdown"])
def test_pages_of_any_depth_are_rendered(spark, tmp_path, name):
    n = 30000
    pages = ["<div>" * n + "unten", "<ul><li> " * n + "tief", "<a href=u> " * n + "drei", "<table>" * n + "<b>x</b>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r["markdown"] for r in kernels.book.queries[name](spark, str(tmp_path)).collect()}
    assert found[0] == "unten" and found[1] == "* " * n + "tief" and found[3] == "**x**"
    assert found[2] == ("drei" if name.startswith("A30") else "[" * n + "drei" + "](u)" * n)


def test_notes_and_chats():
    assert len(importers.chat_markdown("User: a\nAssistant: b")) == 1
    assert [m["role"] for m in importers.chat_markdown("x\nUser: a\nAssistant: b\nUser: c")] == ["system", "user", "model", "user"]


def test_role_lines_after_blank_lines():
    """A role may follow any blank lines, which are read once."""
    rng, role = random.Random(8), re.compile(r"(?im)^\s*(?:#{1,4}\s*)?(?:\*\*)?(user|human|nutzer|assistant|model|ai|system)(?:\*\*)?\s*:(?:\*\*)?[ \t]*")
    bits = ["\n", "\n", " ", "\t", "\r", "\r\n", "\u2028", "\x0b", "# ", "##", "**", "User", "AI", "system", "model", ":", ":", "x", "User: a\n", "\n \n Assistant: b\n"]
    for _ in range(5000):
        content = "".join(rng.choices(bits, k=rng.randrange(40)))
        text = re.sub(r"\n{3,}", "\n\n", content.replace("\r\n", "\n"))
        marks = list(role.finditer(text))
        names = {"assistant": "model", "model": "model", "ai": "model", "system": "system"}
        want = [("user", text.strip())] if len(marks) <= 2 else [("system", text[: marks[0].start()].strip())]
        ends = [*(m.start() for m in marks[1:]), len(text)]
        want += [(names.get(m[1].lower(), "user"), text[m.end() : end].strip()) for m, end in zip(marks, ends)] if len(marks) > 2 else []
        assert [(m["role"], m["content"]) for m in importers.chat_markdown(content)] == [x for x in want if x[1]]
    began = time.perf_counter()
    assert len(importers.chat_markdown("\n \n" * 20000 + "User: a\nAI: b" + "\n \n" * 20000 + "User: c")) == 3
    assert time.perf_counter() - began < 2


def test_epub_reads_the_spine():
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="urn:o" xmlns:dc="urn:dc"><metadata><dc:title>Buch</dc:title></metadata><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<html><body><h2>Eins</h2><p>" + "Wort " * 30 + "</p></body></html>")
    (message,) = importers.epub(box.getvalue())
    assert message["content"].startswith("**Titel:** Buch\n\n## Eins")


def test_fb2_reads_bodies():
    (message,) = importers.fb2(b"<FictionBook><description><book-title>T</book-title></description><body><section><p>Ein Satz.</p></section></body></FictionBook>")
    assert message["content"] == "**Titel:** T\n\nEin Satz."


def test_running_heads_go():
    pages = [f"Kopf\nInhalt {i} ist lang genug, um als Seite zu zählen.\n{i}" for i in range(6)]
    out = importers.pdf_pages(pages)
    assert not any("Kopf" in m["content"] for m in out)


def test_broken_files_give_no_messages(spark):
    files = spark.createDataFrame([(1, b"{", "gemini_json"), (2, b"x", "epub"), (3, b"x", "nowhere"), (4, None, "chatgpt")], "id int, content binary, platform string")
    assert [r["messages"] for r in importers.read_messages(files, "id", "content", "platform").collect()] == [[]] * 4
