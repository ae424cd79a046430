"""Elements written inside of JavaScript and TypeScript (.jsx, .tsx), turned into array literals.

An element ``<a b="x" c={e} {...s}>text {f} <d/></a>`` is an expression; ``plain`` puts ``[e, ...s, f, [],]`` in its place, so
that the grammars of the languages read what stands in braces, and keeps every line break, so that places stay
right. An end tag that does not fit becomes a sign no grammar accepts, an element that never ends an open bracket.
Modes are held in a list: nesting has no bound, and a text is passed once.
"""

from __future__ import annotations

import re

BAD = "\x01"
_CODE = re.compile(
    r"\"(?:[^\"\\\r\n]|\\[\s\S])*\"|'(?:[^'\\\r\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z)"
    r"|(?:(?<=[(,=:\[!&|?{};+])|(?<=[(,=:\[!&|?{};+] )|(?<=return ))/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-z]*"
    r"|[{}<]|[^\"'`/{}<]+|[\s\S]"
)
_NAME = r"[A-Za-z_$][\w$]*(?:[-.:][\w$]+)*"
# after <: a name and what may follow it in a tag, or >; type parameters go on with a comma or extends
_OPENS = re.compile(r"<(?:>|(?P<name>" + _NAME + r")(?=[\s/>])(?!\s+extends\b)(?!\s*,))")
_BEFORE = re.compile(r"(?:[(,=:\[!&|?{};>+]|\breturn|\bdefault|\bcase|\byield|\A)\s*\Z")
_ATTRIBUTE = re.compile(r"\s+|(?P<end>/?>)|(?P<hole>\{)|(?P<value>=\s*(?:\"[^\"]*\"|'[^']*'|(?P<open>\{)|(?=<)))|" + _NAME + r"|/\*[\s\S]*?\*/|//[^\r\n]*")
_CHILD = re.compile(r"(?P<close></\s*(?P<name>" + _NAME + r")?\s*>)|(?P<open><(?:>|(?P<tag>" + _NAME + r")))|(?P<hole>\{)|[^<{]+|[\s\S]")
_COMMENT = re.compile(r"//[^\r\n]*|/\*[\s\S]*?\*/")


def _lines(text: str) -> str:
    return "".join(c for c in text if c in "\r\n")


def plain(text: str) -> str:
    """The text with its elements as array literals."""
    out: list[str] = []
    modes: list[list] = [["code", 0]]  # code: depth of braces; tag, children: the element's name
    at, size = 0, len(text)
    recent = ""  # the end of the code written last, without comments
    while at < size:
        mode = modes[-1]
        if mode[0] == "code":
            m = _CODE.match(text, at)
            x = m.group()
            if x == "<" and (opened := _OPENS.match(text, at)) and _BEFORE.search(recent):
                out.append("[")
                at = opened.end()
                modes.append(["tag" if opened["name"] else "children", opened["name"] or ""])
                continue
            at = m.end()
            if x == "{":
                mode[1] += 1
            elif x == "}":
                if mode[1] == 0 and len(modes) > 1:  # the hole ends
                    out.append(",")
                    modes.pop()
                    continue
                mode[1] -= 1
            out.append(x)
            if not _COMMENT.fullmatch(x):
                recent = (recent + x)[-40:]
        elif mode[0] == "tag":
            m = _ATTRIBUTE.match(text, at)
            if not m:
                out.append(BAD)
                at += 1
                continue
            at = m.end()
            if m["end"] == "/>":
                modes.pop()
                out.append("]")
                recent = "]"
            elif m["end"]:
                mode[0] = "children"
            elif m["hole"] or m["open"]:
                modes.append(["code", 0])
                recent = "{"
            elif m["value"] and text.startswith("<", at) and (opened := _OPENS.match(text, at)):
                out.append("[")
                at = opened.end()
                modes.append(["tag" if opened["name"] else "children", opened["name"] or ""])
            else:
                out.append(_lines(m.group()))
        else:
            m = _CHILD.match(text, at)
            at = m.end()
            if m["close"]:
                out.append("]" if (m["name"] or "") == mode[1] else BAD)
                modes.pop()
                recent = "]"
            elif m["open"]:
                out.append("[")
                modes.append(["tag" if m["tag"] else "children", m["tag"] or ""])
            elif m["hole"]:
                modes.append(["code", 0])
                recent = "{"
            else:
                x = m.group()
                out.append(BAD if x == "<" or ">" in x.replace("=>", "") or "}" in x else _lines(x))
        if len(modes) > 1 and modes[-1][0] != "code" and out and out[-1] == "]":
            out.append(",")  # an element inside of an element
    return "".join(out)
