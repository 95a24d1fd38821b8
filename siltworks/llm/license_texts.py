"""Known licence texts: the standard texts beside this file, whole and by paragraphs, in the forms in which they are commonly published.

A paragraph that several licences share says only that it is one of them; its id names all of them, joined by OR. The texts of AGPL-3.0 and of
the Creative Commons 4.0 licences but BY-SA are not held, so paragraphs that GPL-3.0 and CC-BY-SA-4.0 share with them are named alike.
"""

from __future__ import annotations

import re
import textwrap
from pathlib import Path

FOLDER = Path(__file__).parent / "licenses"
#: Paragraphs of fewer words (headings such as "Preamble") say nothing by themselves.
LEAST_WORDS = 12
#: Texts that are published under several titles, or none, and in lines of any width.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "Unlicense": (),
}
WIDTHS = range(60, 90)
#: Paragraphs with these words are their licence's alone; all others of the text are shared with the licences on the right.
SHARED = {
    "GPL-3.0": (r"GNU\s+General\s+Public\s+License|GNU\s+Affero", "AGPL-3.0 OR GPL-3.0"),
    "CC-BY-SA-4.0": (r"Attribution-ShareAlike|BY-SA", "LicenseRef-CC-4.0"),
}


def plain(text: str) -> str:
    """The canonical form of these texts, which are ASCII, before spellings are unified."""
    text = re.sub(r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$", "", text.lower())
    return " ".join(re.findall(r"[^\W_]+", text))


def _paragraphs(text: str) -> list[str]:
    return [p for p in re.split(r"\n[ \t]*\n", text.replace("\f", "\n").strip("\n")) if p.strip()]


def _wrapped(paragraphs: list[str]) -> list[list[str]]:
    """The paragraphs on one line each, and in lines of each width, further lines indented or not."""
    flat = [" ".join(p.split()) for p in paragraphs]
    indents = [paragraphs, flat] + [[textwrap.fill(p, w, subsequent_indent=" " * i if re.match(r"\d\. ", p) else "", break_on_hyphens=False) for p in flat] for w in WIDTHS for i in (0, 3)]
    return list({tuple(map(plain, x)): x for x in reversed(indents)}.values())


def _forms(name: str, text: str) -> tuple[list[str], list[str]]:
    """Whole texts and paragraphs."""
    if name not in TITLES:
        parts = _paragraphs(text)
        end = next((i for i, p in enumerate(parts) if plain(p) == "end of terms and conditions"), len(parts))
        bodies = [parts[a:b] for a in (0, 1) for b in sorted({end, end + 1, len(parts)})]
        wholes = ["\n\n".join(x) for x in bodies]
        pieces = [x for p in parts for x in (p, " ".join(p.split()))]
        secure = lambda x: x.replace("http://", "https://")
        return [*wholes, *map(secure, wholes)], [*pieces, *map(secure, pieces)]
    wholes, pieces = [], []
    for holder in ("HOLDER OR", "OWNER OR") if name.startswith("BSD") else ("",):
        parts = _paragraphs(text.replace("HOLDER OR", holder) if holder else text)
        for marks in ("keep", "drop") if name.startswith("BSD") else ("keep",):
            body = [re.sub(r"^\s*\d\. ", "", p) for p in parts] if marks == "drop" else parts
            for wrapped in _wrapped(body):
                pieces += wrapped
                listed = [p for p in wrapped if re.match(r"\d\. |Redistributions|Neither", p)]
                if listed:  # conditions without empty lines between them
                    first = wrapped.index(listed[0])
                    pieces += ["\n".join(listed), "\n".join(wrapped[first - 1 : first + len(listed)])]
                for title in ("", *TITLES[name]):
                    for rights in ("", "All rights reserved.") if name.startswith("BSD") else ("",):
                        wholes.append("\n\n".join([x for x in (title, rights) if x] + wrapped))
    return wholes, pieces


def known_texts() -> list[tuple[str, str]]:
    """License ids and texts, one per canonical form."""
    whole: dict[str, tuple[str, str]] = {}
    owners: dict[str, tuple[set[str], str]] = {}
    for path in sorted(FOLDER.glob("*.txt")):
        name = path.stem
        wholes, pieces = _forms(name, path.read_text())
        for text in wholes:
            whole.setdefault(plain(text), (name, text))
        own, shared = SHARED.get(name, ("", name))
        for text in pieces:
            key = plain(text)
            if len(key.split()) >= LEAST_WORDS:
                owners.setdefault(key, (set(), text))[0].update([name] if re.search(own, text, re.I) else shared.split(" OR "))
    parts = {k: (" OR ".join(sorted(ids)), text) for k, (ids, text) in owners.items()}
    return list((parts | whole).values())
