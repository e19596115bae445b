"""Stand-ins for a model, for queries and tests: what they answer depends on the prompt alone."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd


def bucket(key: str, parts: int) -> int:
    """A repeatable number from 0 to parts - 1: the first four hex digits of the md5."""
    return int(hashlib.md5(key.encode()).hexdigest()[:4], 16) % parts


def answers(rows: list[dict], key: str = "city", failures: int = 10, seed: int = 0) -> list:
    """1 to 3 answers for each row, or a failure, by hash."""
    out: list = []
    for r in rows:
        k = f"{r[key]}-{seed}"
        out.append(RuntimeError("offline failure") if bucket(k, 100) < failures else [{"answer": f"{r[key]}_{i}"} for i in range(1, bucket(f"{k}-n", 3) + 2)])
    return out


def model(asked: list[str]) -> list[str]:
    """One record that repeats the prompt's length."""
    return [f'```json\n[{{"question": "q{len(p)}", "answer": "a{len(p)}"}}]\n```' for p in asked]


def echo(asked: list[str]) -> list[str]:
    """One record with the md5 of the prompt's first line."""
    name = lambda p: hashlib.md5(p.split("\n")[0].encode()).hexdigest()[:8]
    return [f'[{{"question": "q-{name(p)}", "answer": "a-{name(p)}"}}]' for p in asked]


def scripted(asked: list[str]) -> list[str]:
    """Answers each kind of prompt of the composite jobs; some calls and solutions are wrong at first, by the prompt's words."""

    def one(p: str) -> str:
        if m := re.match(r"Name (\d+) subtopics of (.*) \(part (\d+)\)", p):
            return "[%s]" % ", ".join(f'{{"subtopic": "{m[2]} {int(m[3])}-{i}"}}' for i in range(int(m[1])))
        if m := re.match(r"Write a query and its calls of (\S+) about (.*)", p):
            arguments = f'"location": "{m[2]}"' if bucket(m[2], 3) else ""
            return '[{"query": "where is %s", "answer": [{"name": "%s", "arguments": {%s}}]}]' % (m[2], m[1], arguments)
        if m := re.match(r"Mend the calls of (\S+) for the query: where is (.*)\. They were wrong: (.*)", p):
            arguments = f'"location": "mended {m[2]}"' if m[3].startswith("missing parameters") else ""
            return '[{"query": "where is %s", "answer": [{"name": "%s", "arguments": {%s}}]}]' % (m[2], m[1], arguments)
        if p.startswith("Does"):
            return '[{"match": "Yes"}]'
        if m := re.match("Write problems about (.*)", p):
            return "[%s]" % ", ".join(f'{{"problem": "{m[1]}/{i}", "answer": "{"bad" if bucket(f"{m[1]}/{i}", 2) else "good"} {i}", "reasoning": "r"}}' for i in range(2))
        if m := re.match("Rewrite the solution of (.*)", p):
            return '[{"problem": "%s", "answer": "%s", "reasoning": "r"}]' % (m[1], "bad again" if bucket(m[1] + "-again", 4) == 0 else "mended")
        if p.startswith("Is the answer"):
            return '[{"verified": "%s"}]' % ("False" if " bad" in p else "True")
        return "none"

    return [one(p) for p in asked]


def as_docx(frames):
    """(path, text) as (path, content): minimal docx files, a paragraph for each line."""
    for frame in frames:
        content = []
        for text in frame["text"]:
            body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
            content.append(out.getvalue())
        yield pd.DataFrame({"path": frame["path"], "content": content})
