"""Exports of chat platforms, books and notes as messages (role, content, model_name).

An importer is a function of one file. Importers run in Arrow batches over a DataFrame of
files, so a corpus of exports is read in parallel and a bad file gives no messages.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources import dom
from textloom.sources.dom import Node, markdown

MESSAGE = "array<struct<role:string,content:string,model_name:string>>"
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string()), ("model_name", pa.string())]))

# Markers of the platforms' pages, in the order that decides ties.
MARKERS = {
    "chatgpt": ("data-message-author-role", "conversation-turn"),
    "kimi": ("chat-content-item-user", "chat-content-item-assistant"),
    "claude": ("font-user-message", "font-claude-message"),
    "gemini": ("message-box", "ai-markdown-artifact-renderer", "bard-chat-ui", "markdown-main-panel"),
    "hotbot": ("tyn-qa-item", "tyn-qa-item-usr"),
    "lmarena": ('data-sentry-component="sidebysideorstackedmessagegroup"', "bg-surface-primary relative flex w-full"),
    "deepseek": ("ds-message-item", "ds-chat-container", "deepseek-chat"),
    "wikisource": ("mw-parser-output", "mediawiki", "mw-content-text", "ws-noexport"),
    "grok": ("grok.com", "x.ai", "response-content-markdown", "message-bubble"),
    "perplexity": ("perplexity.ai", "group/query", "prose dark:prose-invert", "pplx-icon"),
    "glm": ("glm-chat-item", "zhipu-ai-response"),
}
EXTENSIONS = {"pdf": "pdf", "epub": "epub", "fb2": "fb2", "md": "markdown", "markdown": "markdown"}


@dataclass(frozen=True)
class Config:
    """Where a platform's page keeps blocks, roles and content."""

    block: str
    user: str
    model: str
    user_content: str
    model_content: str
    role_attribute: str | None = None
    model_name: str | None = None

    def check(self) -> None:
        if not (self.block and self.user and self.model and self.user_content and self.model_content):
            raise ValueError("a parser configuration names a block, both roles and both contents")


# Selectors of the platforms that need no code of their own.
CONFIGS = {
    "chatgpt_config": Config('article[data-testid^="conversation-turn-"]', "user", "assistant", ".whitespace-pre-wrap", ".markdown.prose", "data-message-author-role", "div[data-model-name]"),
    "kimi_config": Config("div.chat-content-item", "chat-content-item-user", "chat-content-item-assistant", "div.user-content", "div.markdown"),
    "claude_config": Config("div[data-test-render-count]", "font-user-message", "font-claude-message", "div.whitespace-pre-wrap", "div.whitespace-pre-wrap"),
    "gemini_config": Config("div.message-box", "message-box--user", "model-response", "span.prompt-response-text-area", "span.ai-markdown-artifact-renderer"),
    "hotbot": Config("div.tyn-qa-item", "tyn-qa-item-usr", "tyn-qa-item-bot", "div.tyn-qa-message", "div.tyn-qa-message"),
    "perplexity_config": Config("div.perplexity-message", "user-message", "assistant-message", "div.content", "div.content"),
    "grok_config": Config("div.grok-response", "user-row", "model-row", "div.text-content", "div.text-content"),
    "glm": Config("div.glm-chat-item", "user-msg", "assistant-msg", "div.msg-content", "div.msg-content"),
}

Message = dict[str, str | None]


def sniff(content: Column, extension: Column) -> tuple[Column, Column]:
    """(platform, confidence) of a file, by JSON keys, page markers, then its extension."""
    value = F.try_parse_json(F.when(F.ltrim(content).rlike(r"^[{\[]"), content))

    def has(path: str) -> Column:
        return F.try_variant_get(value, path, "variant").isNotNull()

    combined = (F.try_variant_get(value, "$.exportType", "string") == "combined") & has("$.dialogue")
    by_json = F.when(combined, "gemini_json").when(has("$.conversations[0].mapping"), "chatgpt_json").when(has("$.chat_messages[0].sender"), "claude_json")
    low = F.lower(content)
    scored = []
    for i, (name, marks) in enumerate(MARKERS.items()):
        hits = sum((F.contains(low, F.lit(m)).cast("int") for m in marks), F.lit(0))
        scored.append(F.struct(hits.alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name"), (hits / len(marks)).alias("share")))
    best = F.array_max(F.array(*scored))
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    hint = F.try_element_at(known, F.lower(extension))
    name = F.coalesce(by_json, F.when(best["hits"] > 0, best["name"]), hint)
    share = F.when(by_json.isNotNull(), 1.0).when(best["hits"] > 0, best["share"]).when(hint.isNotNull(), 0.1).otherwise(0.0)
    return name, share


def says(role: str, content: str, model_name: str | None = None) -> Message:
    return {"role": role, "content": content, "model_name": model_name}


def valid(messages: list[Message]) -> bool:
    return bool(messages) and all(m["role"] in ("user", "model", "system") and (m["content"] or "").strip() for m in messages)


# Class parts of elements that hold a model's thinking.
THINKING = ("thoughts", "reasoning", "model-thoughts", "ai-llm-model-thoughts", "think-aloud", "thinking-content")


def thinking(node: Node) -> str:
    """The thinking block of a message as a quotation, or nothing."""
    box = next((n for n in node.nodes() if any(m in n.attrs.get("class", "").lower() for m in THINKING) or n.tag == "ai-llm-model-thoughts-output-box"), None)
    raw = re.sub(r"(?i)^\s*Thought for \d+ seconds?\s*", "", box.text()).strip() if box else ""
    return "> **Thinking:**\n> " + raw.replace("\n", "\n> ") + "\n\n" if raw else ""


def by_config(root: Node, cfg: Config) -> list[Message]:
    out = []
    for block in root.select(cfg.block):
        role = None
        if cfg.role_attribute:
            author = block.first(f"[{cfg.role_attribute}]")
            role = {cfg.user: "user", cfg.model: "model"}.get(author.attrs[cfg.role_attribute]) if author else None
        else:
            for name, cls in (("user", cfg.user), ("model", cfg.model)):
                role = role or (name if cls in block.classes else None)
            for name, cls in (("user", cfg.user), ("model", cfg.model)):
                role = role or (name if block.first(f".{cls}") else None)
        held = block.first(cfg.user_content if role == "user" else cfg.model_content) if role else None
        text = thinking(block) + markdown(held) if held else ""
        if text:
            badge = block.first(cfg.model_name) if role == "model" and cfg.model_name else None
            out.append(says(role, text, badge.text("") if badge else None))
    return out


def chatgpt(root: Node) -> list[Message]:
    out, badge = [], None
    for el in root.nodes():
        if el.tag == "div" and re.search(r"GPT-|o1-|o3-", "".join(c for c in el.children if isinstance(c, str))):
            badge = el.text("")
        role = {"user": "user", "assistant": "model"}.get(el.attrs.get("data-message-author-role", ""))
        if role is None:
            continue
        thought = el.first('.thought-content, details[data-testid="reasoning-details"]')
        quoted = "\n".join(f"> {line}" for line in thought.text().split("\n")) if thought and thought.text() else ""
        text = (f"> **Thinking:**\n{quoted}\n\n" if quoted else "") + markdown(el.first(".markdown") or el.first(".whitespace-pre-wrap") or el)
        if text.strip():
            out.append(says(role, text, badge))
    return out


def claude(root: Node) -> list[Message]:
    out: list[Message] = []
    for div in root.select("div"):
        if div.attrs.get("data-testid") == "user-message":
            role, text = "user", (div.first("p.whitespace-pre-wrap") or div).text()
        elif "font-claude-response" in div.classes:
            role, text = "model", div.text()
            lines = text.split("\n")
            if len(lines) > 1 and lines[0] == lines[1]:
                text = "\n".join(lines[1:])
        else:
            continue
        if not text or out and text in (out[-1]["content"] or ""):
            continue  # the same words again, or a part of the message before
        out.append(says(role, text[4:].strip() if role == "user" and text.startswith("User") else text))
    return out


# Words of the page around a conversation.
PAGE_WORDS = ("DeepSeek", "Copy", "Regenerate", "Good response", "Bad response", "Share", "Edit", "Delete", "New Chat", "Heute", "7 Tage", "30 Tage")
USER_CLASS = "fbb737a4"


def deepseek(root: Node) -> list[Message]:
    """The first of four readings that finds anything."""
    for read in (_deepseek_pairs, _deepseek_messages, _deepseek_leaves, _deepseek_blocks):
        if found := read(root):
            return found
    return []


def _thought_tag(node: Node) -> str:
    box = next((n for n in node.nodes() if "thinking" in n.attrs.get("class", "").lower()), None)
    return f"<thinking>\n{box.text()}\n</thinking>\n\n" if box else ""


def _deepseek_pairs(root: Node) -> list[Message]:
    out = []
    for wrap in root.select("div[data-um-id]"):
        if (said := wrap.first(f"div.{USER_CLASS}")) and said.text():
            out.append(says("user", said.text()))
        answer = wrap.next_element("div")
        if answer and (held := answer.first("div.ds-markdown")) and markdown(held):
            out.append(says("model", _thought_tag(answer) + markdown(held)))
    return out


def _deepseek_messages(root: Node) -> list[Message]:
    out = []
    for div in root.where(lambda n: n.tag == "div" and any("ds-message" in c for c in n.classes)):
        user = "user" in " ".join(div.classes).lower() or USER_CLASS in div.classes or any(USER_CLASS in n.classes for n in (*div.above(), *div.nodes()))
        text = (next(iter(div.where(lambda n: "ds-markdown" in n.attrs.get("class", ""))), None) or div).text()
        text = text if user else _thought_tag(div) + text
        if text:
            out.append(says("user" if user else "model", text))
    return out


def _deepseek_leaves(root: Node) -> list[Message]:
    theme = next((n for n in root.nodes() if "ds-theme" in n.attrs.get("class", "")), None)
    leaves = theme.where(lambda n: n.tag in ("div", "p") and all(isinstance(c, str) for c in n.children)) if theme else []
    out, role = [], "user"
    for text in (n.text() for n in leaves):
        if len(text) <= 5 or any(w in text for w in PAGE_WORDS):
            continue
        role = "model" if len(text) > 500 else role
        out.append(says(role, text))
        role = "model" if role == "user" else "user"
    return out


def _deepseek_blocks(root: Node) -> list[Message]:
    bare = root.without("script, style, nav, header, footer")
    texts = list(dict.fromkeys(t for t in (n.text() for n in bare.select("div, p")) if len(t) > 20))
    return [says("model" if i % 2 else "user", t) for i, t in enumerate(texts[:10])]


def gemini(root: Node) -> list[Message]:
    out, thoughts = [], ""
    for el in root.where(lambda n: n.tag in ("user-query", "model-thoughts", "message-content")):
        held = el.first("div.markdown")
        if el.tag == "user-query":
            said = el.first("div.query-text")
            text = said.text() if said else el.text().replace("text_minimize", "").replace("content_copy", "").strip()
            text = re.sub(r"^Du hast gesagt\s*", "", text).strip()
            if text:
                out.append(says("user", text))
        elif el.tag == "model-thoughts":
            if held:
                thoughts += ("\n" if thoughts else "") + "> **Thinking:**\n> " + held.text().replace("\n", "\n> ") + "\n\n"
        elif text := thoughts + (held or el).text():
            out.append(says("model", text))
            thoughts = ""
    if any(m["role"] == "user" for m in out) and valid(out):
        return out
    boxes = []
    for box in root.select("div.message-box"):
        role = "user" if "message-box--user" in box.classes else "model"
        parts = [thinking(box)] if thinking(box) else []
        parts += [r.text() for r in box.select("span.ai-markdown-artifact-renderer") if not any(a.tag == "ai-llm-model-thoughts-output-box" for a in r.above())]
        if role == "user" and not parts:
            parts = [n.text() for n in box.select("span.prompt-response-text-area")[:1]]
        if text := "\n".join(parts).strip():
            boxes.append(says(role, text))
    return boxes if valid(boxes) else []


def grok(root: Node) -> list[Message]:
    out = []
    for bubble in root.select("div.message-bubble"):
        held, cls = bubble.first("div.response-content-markdown"), set(bubble.classes)
        role = "user" if {"rounded-br-lg", "bg-surface-l1"} <= cls else "model" if {"w-full", "max-w-none"} <= cls else None
        if held and role and (text := markdown(held, links=True, fences=True)):
            out.append(says(role, text))
    return out


def perplexity(root: Node) -> list[Message]:
    asked, answers = root.select("span.select-text"), root.select("div.prose.dark:prose-invert")
    out = []
    if asked and answers:
        for i in range(max(len(asked), len(answers))):
            out += [says("user", n.text("")) for n in asked[i : i + 1] if n.text("")]
            out += [says("model", markdown(n, links=True)) for n in answers[i : i + 1] if markdown(n, links=True)]
    return out


def kimi(root: Node) -> list[Message]:
    out = []
    for item in root.where(lambda n: n.tag == "div" and "chat-content-item" in n.attrs.get("class", "")):
        role = "user" if any("user" in c for c in item.classes) else "model"

        def part(*names: str, item: Node = item) -> Node | None:
            return next((n for n in item.nodes() if any(x in c for c in n.classes for x in names)), None)

        text = (part("markdown") or part("text", "content") or item).text()
        text = re.sub("^You" if role == "user" else "^Kimi", "", text).strip()
        if text:
            out.append(says(role, text))
    return out


def lmarena(root: Node) -> list[Message]:
    """Turns in time order; each model of a side-by-side turn is a message with its name."""
    turns: list[list[Message]] = []
    for block in root.where(lambda n: n.tag == "div" and ("self-end" in n.classes or any("lg:flex-row" in c for c in n.classes))):
        if "self-end" in block.classes:
            if held := block.first("div.prose"):
                turns.append([says("user", held.text())])
            continue
        cards = []
        for card in block.where(lambda n: n.tag == "div" and {"bg-surface-primary", "relative", "flex", "w-full"} <= set(n.classes)):
            name, reason, held = card.first("span.truncate"), card.first('div[data-sentry-component="ReasoningContent"]'), card.first("div.prose")
            raw = re.sub(r"^Thought for \d+ seconds", "", reason.text()).strip() if reason else ""
            text = ("> **Thinking:**\n> " + raw.replace("\n", "\n> ") if raw else "") + (held.text() if held else "")
            if name and text:
                cards.append(says("model", text, name.text("")))
        if cards:
            turns.append(cards)
    return [m for turn in reversed(turns) for m in turn]


# What a wiki page holds besides its text.
WIKI_NOISE = 'nav, header, footer, .mw-editsection, script, style, noscript, .printfooter, .catlinks, .mw-cite-backlink, [class*="ve-ce-"], [class*="oo-ui-"], [style*="display:none"], [style*="display: none"], .mw-editsection-bracket, .mw-ext-cite-error'


def wikisource(root: Node) -> list[Message]:
    held = root.first("div.mw-parser-output") or root.first("div#mw-content-text")
    if held is None:
        return []
    text = re.sub(r"\n{3,}", "\n\n", held.without(WIKI_NOISE).text())
    text = re.sub(r"[a-z]+:[a-z]+\}\.ve-ce-[a-zA-Z\-.]+\{[^}]*\}|(?s:\b(?:var|const|let|function)\s+\w+\s*[=(].*?[;}])|(?s:\{[\"'][\w-]+[\"']\s*:\s*[{\[\"].*?\})", "", text).strip()
    if len(text) < 50:
        return []
    title, author = root.first("h1#firstHeading"), root.first('meta[name="author"]')
    by = author.attrs.get("content") if author else None
    return [says("model", f"**{title.text('') if title else 'Wikisource Dokument'}**\n" + (f"*Autor: {by}*\n" if by else "") + f"*Quelle: Wikisource*\n\n---\n\n{text}")]


def gemini_json(text: str) -> list[Message]:
    data = json.loads(text)
    out = [says({"assistant": "model"}.get(d.get("role"), d.get("role")), (d.get("content") or "").strip()) for d in data.get("dialogue", []) if d.get("role") != "thought"]
    out = [m for m in out if m["role"] in ("user", "model")]
    return out if valid(out) else []


#: From the line of the role on: if it could begin in the blank lines before, each of them would be read to its end again.
ROLE_LINE = re.compile(r"(?im)^[^\S\n]*(?:#{1,4}\s*)?(?:\*\*)?(user|human|nutzer|assistant|model|ai|system)(?:\*\*)?\s*:(?:\*\*)?[ \t]*")


def chat_markdown(content: str) -> list[Message]:
    """A note; with more than two role lines it is split at them."""
    text = content.removeprefix("﻿").replace("\r\n", "\n")
    text = re.sub(r"\n{3,}", "\n\n", text) if "\n\n\n" in text else text
    marks = list(ROLE_LINE.finditer(text))
    if len(marks) <= 2:
        return [says("user", text.strip())] if text.strip() else []
    out = [says("system", text[: marks[0].start()].strip())]
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        name = m[1].lower()
        role = "model" if name in ("assistant", "model", "ai") else "system" if name == "system" else "user"
        out.append(says(role, text[m.end() : after.start() if after else len(text)].strip()))
    return [m for m in out if m["content"]]


def slices(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def snapped(text: str, size: int = 15000) -> list[str]:
    """Slices that end at the last paragraph (else sentence) of their second half."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            for mark in ("\n\n", ". "):
                cut = text.rfind(mark, at, end)
                if cut > at + size // 2:
                    end = cut + len(mark)
                    break
        out.append(text[at:end].strip())
        at = end
    return [x for x in out if x]


def message_density(sample: str) -> float:
    """Signs of a chat for every thousand characters of the first five thousand."""
    sample = sample[:5000]
    signs = re.findall(r"(?im)^\s*(?:user|human|assistant|model|ai|du|ich|chatgpt|claude|gemini)\s*:|^#{1,3}\s*(?:user|assistant)|\d{1,2}:\d{2}", sample)
    return len(signs) * 1000 / len(sample) if sample else 0.0


def adaptive_size(density: float) -> int:
    return min(50000, max(10000, int(1000 / (0.5 if density <= 0.1 else density) * 12)))


def plain_text(text: str) -> list[Message]:
    """A book as excerpts; denser chat logs need a model slot to split and stay whole here."""
    if message_density(text) >= 0.5:
        return [says("user", text.strip())] if text.strip() else []
    return [says("user", f"**[Buch-Auszug Teil {i}]**\n\n{part}") for i, part in enumerate(snapped(text), 1)]


def tidy(text: str) -> str:
    """White space, French elisions and the space before marks set right."""
    text = re.sub(r"[ \t ]+", " ", text)
    text = re.sub(r"(\b[ldjmtscnLDJMTSCN]|qu|Qu)['’] +", r"\1'", text)
    text = re.sub(r"\b(\d+) (er|e|ème|re)\b", r"\1\2", text)
    text = re.sub(r" +([,.;:!?)])", r"\1", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def epub(content: bytes) -> list[Message]:
    """Chapters in the order of the spine."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        path = next(e.attrib["full-path"] for e in box.iter() if e.tag.endswith("rootfile"))
        opf = ElementTree.fromstring(z.read(path))
        files = {e.attrib["id"]: e.attrib["href"] for e in opf.iter() if e.tag.endswith("}item")}
        title = next((e.text or "" for e in opf.iter() if e.tag.endswith("}title")), "")
        base = path.rpartition("/")[0]
        parts = []
        for ref in (e.attrib["idref"] for e in opf.iter() if e.tag.endswith("}itemref")):
            root = dom.parse(z.read(f"{base}/{files[ref]}" if base else files[ref])).without("script, style, nav, header, footer")
            text = tidy(markdown(root))
            if len(text) > 50:
                parts.append(text)
    whole = "\n\n---\n\n".join(parts)
    return [says("user", f"**Titel:** {title}\n\n{x}") for x in slices(whole, 15000)]


def fb2(content: bytes) -> list[Message]:
    root = ElementTree.fromstring(content)
    title = next((e.text or "" for e in root.iter() if e.tag.endswith("book-title")), "")
    paragraphs = ["".join(p.itertext()).strip() for body in root.iter() if body.tag.endswith("}body") or body.tag == "body" for p in body.iter() if p.tag.rpartition("}")[2] in ("p", "v", "subtitle")]
    return [says("user", f"**Titel:** {title}\n\n{x}") for x in slices(tidy("\n\n".join(p for p in paragraphs if p)), 15000)]


def running_lines(pages: list[str]) -> set[str]:
    """Lines among the first or last two of at least half of the pages."""
    seen: dict[str, int] = {}
    for page in pages:
        lines = [x.strip() for x in page.split("\n") if x.strip()]
        for line in set(lines[:2] + lines[-2:]):
            seen[line] = seen.get(line, 0) + 1
    return {line for line, n in seen.items() if len(pages) > 1 and n >= 0.5 * len(pages)}


def page_text(text: str, running: set[str]) -> str:
    lines = [x.strip() for x in text.split("\n")]
    kept = "\n".join(x for x in lines if x and x not in running and not re.fullmatch(r"(?:Seite\s+)?\d+", x))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(\w+)-\n\s*(\w+)", r"\1\2", kept))


def pdf_pages(pages: list[str]) -> list[Message]:
    """Texts of the pages of a PDF, which a plug-in supplies, as messages."""
    running = running_lines(pages)
    texts = [page_text(p, running) for p in pages]
    whole = "\n\n".join(f"--- Seite {i} ---\n\n{x}" if len(pages) > 5 else x for i, x in enumerate(texts, 1) if x)
    if len(whole) < 100:
        return []
    return [says("system", f"PDF-Dokument mit {len(pages)} Seiten"), *(says("user", x) for x in slices(whole, 20000))]


def _html(read: Callable[[Node], list[Message]]) -> Callable[[bytes], list[Message]]:
    return lambda content: read(dom.parse(content))


def _text(read: Callable[[str], list[Message]]) -> Callable[[bytes], list[Message]]:
    def run(content: bytes) -> list[Message]:
        try:
            return read(content.decode("utf-8"))
        except UnicodeDecodeError:
            return read(content.decode("latin-1"))

    return run


IMPORTERS: dict[str, Callable[[bytes], list[Message]]] = {
    **{name: _html(read) for name, read in {"chatgpt": chatgpt, "claude": claude, "deepseek": deepseek, "gemini": gemini, "grok": grok, "perplexity": perplexity, "kimi": kimi, "lmarena": lmarena, "wikisource": wikisource}.items()},
    **{name: _html(lambda root, cfg=cfg: by_config(root, cfg)) for name, cfg in CONFIGS.items()},
    "gemini_json": _text(gemini_json), "markdown": _text(chat_markdown), "text": _text(plain_text), "epub": epub, "fb2": fb2,
}


@dataclass(frozen=True)
class Info:
    title: str
    formats: tuple[str, ...]
    experimental: bool
    description: str


# What is shown of each platform.
INFO = {
    "chatgpt": Info("ChatGPT (OpenAI)", (".html",), False, "Import von ChatGPT HTML-Exports"),
    "claude": Info("Claude (Anthropic)", (".html",), False, "Import von Claude HTML-Exports"),
    "gemini": Info("Gemini (Google)", (".html",), False, "Import von Gemini HTML-Exports"),
    "gemini_json": Info("Gemini JSON (Chrome Extension)", (".json",), False, "Import von Gemini JSON-Exports (gemini-export Extension)"),
    "deepseek": Info("DeepSeek", (".html",), False, "Import von DeepSeek HTML-Exports"),
    "kimi": Info("Kimi (Moonshot)", (".html",), False, "Import von Kimi HTML-Exports"),
    "grok": Info("Grok (X.ai)", (".html",), True, "Import von Grok HTML-Exports (Experimental)"),
    "hotbot": Info("HotBot", (".html",), True, "Import von HotBot HTML-Exports (Experimental)"),
    "perplexity": Info("Perplexity", (".html",), True, "Import von Perplexity HTML-Exports (Experimental)"),
    "lmarena": Info("LM Arena (Chatbot Arena)", (".html",), True, "Import von LM Arena Conversations (Experimental)"),
    "glm": Info("GLM-4 (Zhipu AI)", (".html",), True, "Import von GLM-4 HTML-Exports (Experimental)"),
    "wikisource": Info("Wikisource (MediaWiki)", (".html",), False, "Import von Wikisource/MediaWiki HTML-Seiten"),
    "pdf": Info("PDF Document", (".pdf",), False, "Import von PDF-Dokumenten"),
    "epub": Info("EPUB E-Book", (".epub",), False, "Import von EPUB E-Books"),
    "fb2": Info("FictionBook (FB2)", (".fb2",), False, "Import von FB2 E-Books"),
    "markdown": Info("Markdown Document", (".md", ".markdown"), False, "Import von Markdown-Texten, Buchfragmenten und Typora-Notizen"),
    "text_fallback": Info("Text-Parser (Fallback)", (".txt", ".html"), False, "Parser für unbekannte Formate"),
}


def info(platform: Column) -> Column:
    """What is shown of a platform; an unknown one is experimental and has no formats."""
    def known(of: Callable[[Info], Column], default: Column) -> Column:
        cells = [x for name, i in INFO.items() for x in (F.lit(name), of(i))]
        return F.coalesce(F.try_element_at(F.create_map(*cells), platform), default)

    return F.struct(
        known(lambda i: F.lit(i.title), platform).alias("title"),
        known(lambda i: F.array(*map(F.lit, i.formats)), F.array().cast("array<string>")).alias("formats"),
        known(lambda i: F.lit(i.experimental), F.lit(True)).alias("experimental"),
        known(lambda i: F.lit(i.description), F.lit("Unbekannte Plattform")).alias("description"),
    )


def importer(platform: str) -> Callable[[bytes], list[Message]]:
    if platform not in IMPORTERS:
        raise ValueError(f"no importer for {platform}; there are {', '.join(sorted(IMPORTERS))}")
    return IMPORTERS[platform]


def read_messages(files: DataFrame, id_col: str, content_col: str, platform_col: str) -> DataFrame:
    """(id, platform, messages) of each file; unknown platforms and broken files give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, platform in zip(batch.column(1), batch.column(2), strict=True):
                raw, read = content.as_py(), IMPORTERS.get(platform.as_py() or "")
                try:
                    out.append(read(raw) if read and raw is not None else [])
                except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError):
                    out.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, _MESSAGES)], names=["id", "platform", "messages"])

    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("content"), F.col(platform_col).alias("platform"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, platform string, messages {MESSAGE}")


def flat(messages: DataFrame) -> DataFrame:
    """One row a message, in order."""
    return messages.select("id", "platform", F.posexplode("messages").alias("pos", "m")).select("id", "platform", "pos", "m.*")


def arena_chats(messages: DataFrame) -> DataFrame:
    """One log of two models as two chats that share the user's turns."""
    named = messages.filter("model_name is not null").groupBy("id").agg(F.array_sort(F.collect_set("model_name")).alias("names"))
    sides = messages.join(named, "id").select("*", F.posexplode("names").alias("side", "name"))
    return sides.filter("role = 'user' or model_name = name").select(F.concat_ws("-", F.col("id").cast("string"), F.col("side").cast("string")).alias("chat_id"), "pos", "role", "content", F.col("name").alias("model_name"))
