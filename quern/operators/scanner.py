"""A tolerant scanner of source files: definitions with their spans and comments, and call sites.

No grammar is used. Comments and strings are blanked out first, so that brackets match; then definitions are
found by the shape of their headers and ended by their brackets (by indentation in Python). Broken code costs
the definitions it hides, not the rest of the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_DQ, _SQ = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)', r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_CHAR = r"'(?:\\[^\n]{1,10}?|[^\\'\n])'"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:.*?\*/|.*\Z)"
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)'
_REGEX = r"(?<=[(,=:\[!&|?{};\n ])/(?![*/=\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"


def _lexer(comments: list[str], strings: list[str]) -> re.Pattern:
    return re.compile(f"(?P<comment>{'|'.join(comments)})|(?P<string>{'|'.join(strings)})", re.S)


_JS = _lexer([_LINE, _BLOCK], [r"(?P<tick>`)", _DQ, _SQ, _REGEX])
_LEXERS = {
    "python": _lexer([r"#[^\n]*"], [r"[rRbBuUfFtT]{0,2}" + _TRIPLE, r"[rRbBuUfFtT]{0,2}'''(?:\\.|.)*?(?:'''|\Z)", r"(?<![\w])[rRbBuUfFtT]{0,2}" + _DQ, r"(?<![\w])[rRbBuUfFtT]{0,2}" + _SQ, _DQ, _SQ]),
    "javascript": _JS, "typescript": _JS, "tsx": _JS,
    "go": _lexer([_LINE, _BLOCK], [r"`[^`]*(?:`|\Z)", _DQ, _CHAR]),
    "rust": _lexer([_LINE, r"(?P<nest>/\*)"], [r'b?r(?P<hash>#*)".*?(?:"(?P=hash)|\Z)', r'"(?:\\.|[^"\\])*(?:"|\Z)', _CHAR]),
    "c_sharp": _lexer([_LINE, _BLOCK], [r'\$*"""(?:.*?)(?:"""|\Z)', r'(?:@\$?|\$@)"(?:""|[^"])*(?:"|\Z)', r"\$?" + _DQ, _CHAR]),
    "java": _lexer([_LINE, _BLOCK], [_TRIPLE, _DQ, _CHAR]),
    "c": _lexer([_LINE, _BLOCK], [_DQ, _CHAR]),
    "cpp": _lexer([_LINE, _BLOCK], [r'R"(?P<mark>[^\s()\\]{0,16})\(.*?(?:\)(?P=mark)"|\Z)', _DQ, _CHAR]),
    "kotlin": _lexer([_LINE, r"(?P<nest>/\*)"], [r'""".*?(?:"""+|\Z)', _DQ, _CHAR]),
    "swift": _lexer([_LINE, r"(?P<nest>/\*)"], [r'#"+.*?"+#', _TRIPLE, _DQ]),
}


@dataclass
class Comment:
    start: int
    end: int
    text: str


def _nested(source: str, at: int) -> int:
    """The end of a block comment that may hold others."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(source, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(source)


def _template(source: str, at: int) -> int:
    """The end of a template literal, whose ${...} parts may hold braces and templates."""
    depth, i, n = [], at + 1, len(source)
    while i < n:
        c = source[i]
        if c == "\\":
            i += 1
        elif not depth or depth[-1] == "`":
            if c == "`":
                if not depth:
                    return i + 1
                depth.pop()
            elif c == "$" and source[i + 1 : i + 2] == "{":
                depth.append("{")
                i += 1
        elif c == "}":
            depth.pop()
        elif c == "{":
            depth.append("{")
        elif c == "`":
            depth.append("`")
        i += 1
    return n


#: What begins and ends code within a string, and the strings that may hold some.
_CODE_IN = {
    **dict.fromkeys(("javascript", "typescript", "tsx"), (re.compile(r"`"), "${", "}")), "kotlin": (re.compile('"'), "${", "}"), "swift": (re.compile('"'), "\\(", ")"),
    "python": (re.compile("[rRbBuU]?[fFtT]"), "{", "}"), "c_sharp": (re.compile(r"@?\$"), "{", "}"),
}
_PART = re.compile(r"[(){}\[\]]")


def _blank_string(literal: str, language: str) -> str:
    """A string as quotes, but for the code that it holds, which stands in parentheses."""
    blank = lambda s: re.sub(r"[^\n]", '"', s)
    kind, opens, closes = _CODE_IN.get(language, (None, "", ""))
    if kind is None or not kind.match(literal) or opens not in literal:
        return blank(literal)
    out, at = [], 0
    while (i := literal.find(opens, at)) >= 0:
        begin = i + len(opens)
        doubled = opens == "{" and literal[begin : begin + 1] == "{"
        escaped = opens != "\\(" and literal[:i].endswith("\\") and language != "c_sharp"
        if doubled or escaped:
            out.append(blank(literal[at : begin + doubled]))
            at = begin + doubled
            continue
        inner, _, _ = mask(literal[begin:], language)
        depth = 1
        end = next((m.start() for m in _PART.finditer(inner) if (depth := depth + (1 if m[0] in "({[" else -1)) == 0), -1)
        if end < 0 or literal[begin + end] != closes:
            break
        out += [blank(literal[at : begin - 1]), "(", inner[:end], ")"]
        at = begin + end + 1
    return "".join([*out, blank(literal[at:])])


def mask(source: str, language: str) -> tuple[str, list[Comment], list[tuple[int, int]]]:
    """The source with comments as spaces and strings as quotes (line ends, and code within strings, stay), the comments, and the strings' spans."""
    out, at, comments, strings = [], 0, [], []
    lexer = _LEXERS[language]
    blank = lambda s, fill: re.sub(r"[^\n]", fill, s)
    while m := lexer.search(source, at):
        start, end = m.span()
        groups = m.groupdict()
        if groups.get("nest"):
            end = _nested(source, start)
        elif groups.get("tick"):
            end = _template(source, start)
        if end == start:
            end += 1
        out.append(source[at:start])
        if m["comment"] is not None:
            comments.append(Comment(start, end, source[start:end]))
            out.append(blank(source[start:end], " "))
        else:
            strings.append((start, end))
            out.append(_blank_string(source[start:end], language))
        at = end
    out.append(source[at:])
    return "".join(out), comments, strings


class File:
    """A source file with its lines, blanked text and matched brackets."""

    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.text, self.comments, self.strings = mask(source, language)
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.lines = source.splitlines()
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", self.text):
            c = m[0]
            if c in "({[":
                stack.append(m.start())
                continue
            want = {")": "(", "}": "{", "]": "["}[c]
            for back in range(len(stack) - 1, max(-1, len(stack) - 4), -1):  # a few unclosed brackets are passed over
                if self.text[stack[back]] == want:
                    self.pair[stack[back]], self.pair[m.start()] = m.start(), stack[back]
                    del stack[back:]
                    break

    def row(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def code(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first - 1 : last])

    def attached(self, anchor: int) -> list[Comment]:
        """The run of comments before a place, nothing but space between: the nearest within two rows, the rest adjoining."""
        out: list[Comment] = []
        at, row = anchor, self.row(anchor)
        i = bisect_right([c.start for c in self.comments], anchor) - 1 if self.comments else -1
        while i >= 0:
            c = self.comments[i]
            end_row = self.row(max(c.end - 1, c.start))
            if c.end > at or self.source[c.end : at].strip() or end_row < (row - 2 if not out else self.row(out[-1].start) - 1):
                break
            out.append(c)
            at, i = c.start, i - 1
        return out[::-1]


# --- Python -------------------------------------------------------------------------------

_PY_HEAD = re.compile(r"[ \t]*(?:(async[ \t]+)?def|class)[ \t]+(\w+)")


def _python_blocks(f: File):
    """Logical lines: a line within brackets or a string continues the one before it."""
    inside = [False] * (len(f.starts) + 1)
    for a, b in [*f.strings, *((a, b + 1) for a, b in f.pair.items() if a < b)]:
        for r in range(f.row(a) + 1, f.row(b - 1) + 1):
            inside[r] = True
    rows = []
    for r, start in enumerate(f.starts):
        end = f.starts[r + 1] if r + 1 < len(f.starts) else len(f.text)
        line = f.text[start:end].rstrip("\n")
        if not line.strip() or inside[r] or (r and f.source[start - 2 : start - 1] == "\\"):
            continue
        indent = len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())
        rows.append((r, indent, start, line))
    string_at = dict(f.strings)
    out, chain, i = [], [], 0
    while i < len(rows):
        r, indent, start, line = rows[i]
        while chain and chain[-1][0] >= indent:
            chain.pop()
        first = r
        while line.lstrip().startswith("@") and i + 1 < len(rows) and rows[i + 1][1] == indent:
            i += 1
            r, indent, start, line = rows[i]
        m = _PY_HEAD.match(line)
        if not m:
            i += 1
            continue
        head = start + m.end()
        colon = head
        while colon < len(f.text) and f.text[colon] != ":":
            colon = f.pair.get(colon, colon) + 1 if f.text[colon] in "([{" else colon + 1
        j = i + 1
        while j < len(rows) and rows[j][1] > indent:
            j += 1
        last_at = rows[j][2] if j < len(rows) else len(f.text)
        last = f.row(max(start, len(f.text[:last_at].rstrip()) - 1))
        body = colon + 1 + len(f.text[colon + 1 :]) - len(f.text[colon + 1 :].lstrip(" \t\n;\\"))
        doc, doc_end = "", None
        if body in string_at and body < last_at:
            end = string_at[body]
            tail = f.text[end : f.text.find("\n", end) if "\n" in f.text[end:] else len(f.text)].strip()
            if not tail or tail.startswith(";"):
                doc, doc_end = _python_string(f.source[body:end]), f.row(end - 1)
        names = "::".join(n for _, n in chain)
        if "class" in m[0].split():
            out.append(("class_signature", m[2], names, first + 1, (doc_end if doc_end is not None else r) + 1, doc))
            chain.append((indent, m[2]))
            i += 1
        else:
            out.append(("method" if names else "function", m[2], names, first + 1, last + 1, doc))
            i = j
    return out


def _python_string(raw: str) -> str:
    body = raw.strip().lstrip("bBrRuUfFtT")
    for q in ('"""', "'''", '"', "'"):
        if body.startswith(q):
            return body[len(q) : -len(q) if body.endswith(q) and len(body) >= 2 * len(q) else None].strip()
    return raw.strip()


# --- languages with braces ----------------------------------------------------------------

_W = r"[\w$]+"
_JS_MODS = r"(?:(?:public|private|protected|static|abstract|override|readonly|async|get|set|declare|default|export|accessor)\s+)*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|readonly|virtual|override|async|open|data|inline|suspend|operator|inner|annotation|value|enum|expect|actual|tailrec|infix|external|fileprivate|mutating|nonmutating|required|convenience|indirect|lateinit|const|unsafe|extern|new|synchronized|native|default|strictfp|companion|class(?=\s+func)|fun(?=\s+interface)|non-sealed|ref|record(?=\s+(?:class|struct)))\s+)*"
_CLASS = {
    "javascript": rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?!extends\b)({_W})",
    "typescript": rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?!extends\b)({_W})",
    "go": r"type\s+(\w+)", "rust": r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:unsafe\s+)?(?:struct|trait)\s+(\w+)",
    "c_sharp": rf"{_MODS}(?:class|interface|struct)\s+(\w+)", "java": rf"{_MODS}(?:class|@?interface|record)\s+(\w+)",
    "c": r"(?:typedef\s+)?(?:struct|union|enum)\s+(\w+)", "cpp": r"(?:template\s*<.*?>\s*)?(?:typedef\s+)?(?:class|struct|namespace)\s+(?:\w+\(.*?\)\s*)?([\w:]+)",
    "kotlin": rf"{_MODS}(?:class|interface|object)\s+(\w+)", "swift": rf"{_MODS}(?:class|struct|protocol|enum|extension|actor)\s+(?!func\b|var\b)([\w.]+)",
}
_FUNCTION = {
    "javascript": rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*({_W})",
    "go": r"func\s*(?P<receiver>\([^)]*\))?\s*(\w+)", "rust": r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"*\s*)*fn\s+(\w+)",
    "kotlin": rf"{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?, ]+\.)?(`[^`]+`|\w+)", "swift": rf"{_MODS}func\s+([^\s(<]+)",
}
_METHOD = {
    "javascript": rf"{_JS_MODS}\*?\s*(#?{_W}|\[[^\]]*\]|\"+)\s*(?:<[^(]*>)?\s*\(",
    "java": rf"(?:<[^>]*>\s*)?{_MODS}(?:<[^(]*?>\s*)?(?:[\w.<>\[\], ?&@]+?[\s>\]])??(\w+)\s*\(", "c_sharp": rf"{_MODS}(?:[\w.<>\[\], ?]+?[\s>\]?])??([\w.]+)\s*(?:<[^(]*>)?\s*\(",
}
for _of in ("typescript", "tsx"):
    _CLASS[_of], _FUNCTION[_of], _METHOD[_of] = _CLASS["typescript"], _FUNCTION["javascript"], _METHOD["javascript"]
_CLASS, _FUNCTION, _METHOD = ({k: re.compile(v, re.S) for k, v in x.items()} for x in (_CLASS, _FUNCTION, _METHOD))
_ARROW = re.compile(rf"({_W})\s*(?::[^=]*(?:=>[^=]*)?)?=\s*(?:async\s*)?(?:function\b|(?:<[^=]*?>\s*)?(?:\(|{_W}\s*=>))", re.S)
_NOT_CALLABLE = frozenset("if for while switch catch return else do try with function match when guard foreach lock using fixed synchronized new throw sizeof typeof await yield case in of super static assert".split())
_STRUCT_REF = {"c": re.compile(r"\b(?:struct|union|enum)\s+(\w+)"), "cpp": re.compile(r"\b(?:struct|class)\s+(\w+)(?!\s*>)")}
_NEWLINE_ENDS = frozenset(("go", "kotlin", "swift", "javascript", "typescript", "tsx"))
_JS_LIKE = frozenset(("javascript", "typescript", "tsx"))
_METHOD_BY_CHAIN = frozenset(("rust", "cpp", "c_sharp", "kotlin", "swift", "go"))
_GOES_ON = re.compile(r"\s*(?:[{.:?&|+*/=<>,)\]]|->|=>|where\b|throws\b|async\b|extends\b|implements\b|with\b|-)")


class _Braces:
    def __init__(self, f: File):
        self.f, self.t, self.lang, self.out = f, f.text, f.language, []
        self.names: set[int] = set()

    def statement(self, at: int, end: int) -> tuple[int, int]:
        """The end of the header that begins here, and the place of its body's brace (-1: none)."""
        t, f, i = self.t, self.f, at
        assigned = False
        while i < end:
            c = t[i]
            if c == "{":
                return i, i
            if c in "([":
                i = f.pair.get(i, i) + 1
                continue
            if c in ";}":
                return i, -1
            if c == "=" and t[i + 1 : i + 2] not in ("=", ">") and t[i - 1 : i] not in ("=", "!", "<", ">"):
                assigned = True
            if c == "\n" and self.lang in _NEWLINE_ENDS and t[at:i].strip():
                before = t[at:i].rstrip()[-1:]
                if before not in "=,(&|+*/.<:?" and not _GOES_ON.match(t, i) and not t[at:i].lstrip().startswith("@"):
                    return i, -1
            if c == "#" and self.lang in ("c", "cpp") and not t[at:i].strip():  # a directive, with its continued lines
                while True:
                    i = t.find("\n", i)
                    if i < 0 or i >= end:
                        return end, -1
                    if t[i - 1] != "\\":
                        return i, -1
                    i += 1
            i += 1
        del assigned
        return end, -1

    def scan(self, at: int, end: int, chain: str, in_class: bool | str) -> None:
        t, f = self.t, self.f
        while at < end:
            while at < end and (t[at].isspace() or t[at] in ";,)]"):
                at += 1
            if at >= end:
                return
            if t[at] == "}":
                at += 1
                continue
            stop, brace = self.statement(at, end)
            if self.lang == "cpp" and (label := re.compile(r"(?:public|private|protected)\s*:(?!:)").match(t, at)):
                at = label.end()
                continue
            close = f.pair.get(brace, end) if brace >= 0 else stop
            close = min(close, end)
            at = max(self.declaration(at, stop, brace, close, end, chain, in_class), at + 1)

    def declaration(self, at: int, stop: int, brace: int, close: int, end: int, chain: str, in_class: bool) -> int:
        """Handles one statement; returns the place after it."""
        t, lang = self.t, self.lang
        begin = self.attributes(at, stop)
        head = t[begin:stop]
        if lang in _JS_LIKE and (m := re.compile(r"(?:export\s+)?(?:declare\s+)?(?:const|let|var)\b").match(head)):
            return self.variables(at, begin, m.end(), end, chain)
        if lang == "rust" and re.compile(r"(?:unsafe\s+)?impl\b").match(head):
            if brace >= 0:
                name = re.sub(r"^(?:unsafe\s+)?impl\s*", "", head)
                if name.startswith("<"):
                    depth = 0
                    for i, c in enumerate(name):
                        depth += (c == "<") - (c == ">" and name[i - 1] != "-")
                        if not depth:
                            name = name[i + 1 :]
                            break
                name = re.split(r"\bwhere\b", re.split(r"\bfor\b", name)[-1])[0].strip()
                self.scan(brace + 1, close, "::".join(filter(None, (chain, name))), True)
            return close + 1
        m = _CLASS[lang].match(head)
        if m and not (lang == "c" and brace < 0) and not (lang in ("c", "cpp") and "(" in head[m.end() :] and brace >= 0):
            return self.klass(m, at, begin, stop, brace, close, chain)
        if lang == "java" and m is None and re.match(r"enum\b", re.sub(_MODS, "", head)) and brace >= 0:
            self.scan(brace + 1, close, chain, True)
            return close + 1
        name = self.callable(head, begin, brace, in_class, chain)
        if name:
            return self.function(name, at, begin, stop, brace, close, end, chain)
        if lang in _STRUCT_REF and not re.match(r"\s*(?:using|#|template|friend)\b", head):
            for s in _STRUCT_REF[lang].finditer(head):
                if lang == "c" or not re.match(r"\s*[{:;]", head[s.end() :] or ";"):
                    self.emit("class_signature", s[1], chain, at, begin + s.start(), begin + s.end() - 1)
        if brace >= 0:
            in_object = lang in _JS_LIKE and not re.match(rf"\s*(?:{'|'.join(_NOT_CALLABLE)}|interface|type|enum|namespace|module|declare)\b", head)
            self.scan(brace + 1, close, chain, in_class or in_object)
            return close + 1
        return stop + 1

    def attributes(self, at: int, stop: int) -> int:
        """Past annotations, attributes and C# attribute lists."""
        t, f = self.t, self.f
        while at < stop:
            if m := re.compile(r"@(?!interface\b)[\w.:]+\s*").match(t, at):
                at = m.end()
                if t[at : at + 1] == "(":
                    at = f.pair.get(at, at) + 1
            elif (self.lang == "c_sharp" and t[at] == "[") or (self.lang == "rust" and re.match(r"#!?\[", t[at : at + 3])):
                at = f.pair.get(t.index("[", at), at) + 1
            elif t[at].isspace():
                at += 1
            else:
                break
        return at

    def docs(self, anchor: int, inner: int | None = None) -> tuple[str, int | None]:
        """The comment attached to a place and its first row; an exported declaration gets the topmost of the run only."""
        run = self.f.attached(anchor)
        if inner is not None and run:
            top = run[0]
            run = [top] if self.f.row(top.end - 1) >= self.f.row(inner) - 2 else []
        if not run:
            return "", None
        return "\n".join(c.text.strip() for c in run), self.f.row(run[0].start)

    def emit(self, kind: str, name: str, chain: str, anchor: int, inner: int, last_at: int, exported: bool = False) -> None:
        doc, row = self.docs(anchor, inner if exported else None)
        first = row if row is not None else self.f.row(anchor)
        self.out.append((kind, name, chain, first + 1, self.f.row(last_at) + 1, doc))

    @staticmethod
    def exported(head: str) -> int:
        m = re.match(r"export\s+(?:default\s+)?", head)
        return m.end() if m else 0

    def klass(self, m, at: int, begin: int, stop: int, brace: int, close: int, chain: str) -> int:
        lang, name = self.lang, m[1]
        past = self.exported(m[0]) if lang in _JS_LIKE else 0
        after = close + 1
        if lang == "go":
            last = close if brace >= 0 else max(at, stop - 1)
            self.emit("class_signature", name, chain, at, at, last)
            return after
        if lang in ("c", "cpp") and brace < 0 and not re.fullmatch(r"\s*", self.t[begin + m.end() : stop]):
            self.emit("class_signature", name, chain, at, begin, begin + m.end() - 1)
            return stop + 1
        body = brace if brace >= 0 else max(at, stop - 1)
        self.emit("class_signature", name, chain, at, begin + past, body, bool(past))
        if brace >= 0:
            self.scan(brace + 1, close, f"{chain}::{name}" if chain else name, "class")
        return after

    def callable(self, head: str, begin: int, brace: int, in_class: bool, chain: str) -> str:
        lang = self.lang
        if lang in _FUNCTION and (m := _FUNCTION[lang].match(head)):
            if lang == "rust" and brace < 0 or lang in ("typescript", "tsx", "javascript") and brace < 0:
                return ""
            self.names.add(begin + m.start(m.lastindex))
            self.receiver = m["receiver"] if lang == "go" else None
            return m[m.lastindex]
        if lang in _METHOD and (in_class or lang == "c_sharp" and brace >= 0) and (m := _METHOD[lang].match(head)):
            if lang in _JS_LIKE and brace < 0 and in_class == "class" and m[1] not in _NOT_CALLABLE:
                self.names.add(begin + m.start(1))  # a signature: no block, and no call
            if m[1] in _NOT_CALLABLE or (lang in _JS_LIKE and brace < 0) or re.search(r"(?<![=!<>])=(?![=>])", head[: m.end()]):
                return ""
            if brace < 0 and not (chain and re.search(r"\)\s*(?:throws\b[^;]*|=>.*|where\b.*)?$", head, re.S)):
                return ""
            self.names.add(begin + m.start(1))
            return m[1]
        if lang in ("c", "cpp") and brace >= 0 and "(" in head and not re.match(r"\s*(?:extern\s+\"+|namespace\b|enum\b|=)", head):
            m = re.search(r"((?:[\w]+(?:<[^<>]*>)?\s*::\s*)*(?:~?\w+|operator\s*[^\s(]+|operator\s*\(\s*\)))\s*\(", head)
            if m and m[1] not in _NOT_CALLABLE and "=" not in head[: m.start()]:
                self.names.add(begin + m.start(1))
                return re.sub(r"\s+", "", m[1]) if not m[1].startswith("operator") else m[1]
        return ""

    def function(self, name: str, at: int, begin: int, stop: int, brace: int, close: int, end: int, chain: str) -> int:
        lang, head = self.lang, self.t[begin:stop]
        past = self.exported(head) if lang in _JS_LIKE else 0
        if lang == "go" and self.receiver:
            words = self.receiver.strip("() ").split()
            chain = words[-1].lstrip("*") if words else chain
        last = close if brace >= 0 else stop
        if lang in ("kotlin", "c_sharp") and brace < 0:
            last = max(begin, stop if self.t[stop : stop + 1] == ";" else stop - 1)
        kind = "method" if lang in ("java", "c_sharp") and (chain or lang == "java") or (lang in _JS_LIKE and not _FUNCTION[lang].match(head)) or (chain and lang in _METHOD_BY_CHAIN) else "function"
        self.emit(kind, name, chain, at, begin + past, min(last, len(self.t) - 1), bool(past))
        return (close if brace >= 0 else stop) + 1

    def variables(self, at: int, begin: int, offset: int, end: int, chain: str) -> int:
        """A variable statement, which ends at its semicolon or, outside brackets, its line; functions bound in it are blocks."""
        t, f = self.t, self.f
        i, cuts = begin + offset, [begin + offset]
        while i < end:
            c = t[i]
            if c in "([{":
                i = f.pair.get(i, end) + 1
                continue
            if c in ";}":
                break
            if c == ",":
                cuts.append(i + 1)
            if c == "\n" and t[begin:i].strip() and t[begin:i].rstrip()[-1:] not in "=,(&|+*/.<:?>" and not _GOES_ON.match(t, i):
                break
            i += 1
        stop = min(i, end)
        last = stop if t[stop : stop + 1] == ";" else max(begin, len(t[:stop].rstrip()) - 1)
        past = self.exported(t[begin : begin + offset])
        found = False
        for a, b in zip(cuts, [*cuts[1:], stop + 1], strict=True):
            part = t[a : b - 1]
            if (m := _ARROW.match(part.lstrip())) and ("=>" in part or "function" in part):
                found = True
                self.emit("function", m[1], chain, at, begin + past, min(last, len(t) - 1), bool(past))
        if not found:
            i = begin
            while i < stop:
                if t[i] == "{":
                    self.scan(i + 1, f.pair.get(i, stop), chain, True)
                    i = f.pair.get(i, stop)
                elif t[i] in "([":
                    i = f.pair.get(i, stop)
                i += 1
        return stop + 1


def blocks(source: str, language: str) -> list[tuple[str, str, str, int, int, str, str]]:
    """(block_type, name, class_chain, start_line, end_line, docstring, code) of the definitions, in their order."""
    f = File(source, language)
    if language == "python":
        found = _python_blocks(f)
    else:
        walk = _Braces(f)
        walk.scan(0, len(f.text), "", False)
        found = walk.out
    return [(*b, f.code(b[3], b[4])) for b in found if b[1]]


# --- calls --------------------------------------------------------------------------------

_NOT_CALLED = frozenset(
    "if for while switch catch return else do try with function def class fn func fun match when guard foreach lock using fixed synchronized throw sizeof typeof alignof "
    "decltype await yield case in of and or not is lambda except assert del elif print_ defined typeid static_assert where let var const import export delete void unsafe move default".split()
)
_BEFORE_CALL = frozenset(
    "return else throw await new case do in yield not and or is if elif while go defer assert print raise lambda from import delete typeof of when match async try unsafe mut ref move default where until void throws rethrows let".split()
)
_DEFINERS = frozenset("def class function func fun fn macro struct trait impl enum interface record".split())
#: Bodies that hold signatures of methods, but no calls.
_TYPE_BODY = re.compile(r"\b(?:interface\s+[\w$][^{};=]*|type\s+[\w$][^{};=]*=\s*)\{")
_NAME_BACK = re.compile(r"[\w$]")
_BRACED_DEFINITION = frozenset(("javascript", "typescript", "tsx", "java", "c", "cpp", "c_sharp"))


def _callee_start(f: File, end: int) -> int:
    """Where the postfix expression that ends here begins; `end` if there is none."""
    t, i, need = f.text, end, True
    while i > 0:
        j = i
        while j > 0 and t[j - 1].isspace():
            j -= 1
        c = t[j - 1] if j else ""
        if need:
            if c == "}" and j < i + 1 and f.language in ("kotlin", "swift") and (j - 1) in f.pair and i < end:  # a trailing lambda
                i = f.pair[j - 1]
                while i > 0 and t[i - 1] in " \t":
                    i -= 1
                continue
            if c in ")]" and c and (j - 1) in f.pair:
                i = f.pair[j - 1]
                need = c == ")" and i > 0 and bool(_NAME_BACK.match(t[i - 1])) or c == "]"
                if need is False:
                    return i
                continue
            if c and (_NAME_BACK.match(c) or c == '"'):
                k = j
                while k > 0 and (_NAME_BACK.match(t[k - 1]) or t[k - 1] == '"'):
                    k -= 1
                i, need = k, False
                continue
            return i
        for op in ("?.", "!!.", "!.", "::", "->", "."):
            if t[max(0, j - len(op)) : j] == op and (op != "->" or f.language in ("c", "cpp")):
                i, need = j - len(op), True
                break
        else:
            return i
    return i


_ACCESSORS = frozenset("get set init deinit constructor subscript".split())
#: Words before a brace that are no callee, and those that begin a statement whose last word is none.
_NO_LAMBDA = frozenset("else try do init get set willSet didSet finally defer repeat catch object companion when static deinit subscript in is as where".split())
_HEADERS = frozenset("if while for guard switch catch func fun class struct enum extension protocol actor interface object typealias case".split())


def _lambda_calls(f: File) -> list[tuple[int, int, str]]:
    """Calls whose only argument is a trailing lambda: a name or a path of names right before a brace."""
    t, out = f.text, []
    for m in re.finditer(r"[\w)\]][ \t]*\{", t):
        brace, end = m.end() - 1, m.start() + 1
        if t[end - 1] in ")]":
            continue  # with parentheses it is a call already, or the head of a definition
        start = _callee_start(f, end)
        whole = t[start:end].strip()
        if start >= end or t[start] in '"0123456789' or whole in _NO_LAMBDA or not re.match(r"[\w$(]", whole):
            continue
        head = re.split(r"[\n;{}]", t[max(0, start - 200) : start])[-1].strip()
        first, prior = re.match(r"\w*", head)[0], re.search(r"(\w+|->|\W)?$", head)[0]
        if prior == ":" or (prior == "->" and f.language == "swift") or (first in _HEADERS and (f.language == "swift" or prior[-1:] not in "=)")):
            continue
        if re.fullmatch(r"\w+", prior) and prior not in ("return", "throw", "try", "await"):
            continue
        out.append((start, -brace, f.source[start:end].strip()))
    return out


def calls(source: str, language: str) -> list[tuple[str, int, str]]:
    """(callee, line, preview) of the call sites, outer calls before inner ones."""
    f = File(source, language)
    t = f.text
    named: set[int] = set()
    if language != "python":
        walk = _Braces(f)
        walk.scan(0, len(t), "", False)
        named = walk.names
    types = [(m.end(), f.pair.get(m.end() - 1, len(t))) for m in _TYPE_BODY.finditer(t)] if language in ("typescript", "tsx") else []
    out: list[tuple[int, int, str]] = []
    for m in re.finditer(r"\(", t):
        at = end = m.start()
        while end > 0 and t[end - 1] in " \t":
            end -= 1
        generic = None
        if t[end - 1 : end] == ">" and language not in ("python", "c"):
            depth, k = 0, end - 1
            while k >= 0 and k > end - 200:
                depth += (t[k] == ">" and t[k - 1] not in "-=") - (t[k] == "<")
                if depth == 0 and t[k] == "<":
                    break
                if t[k] in ";{}()":
                    k = -1
                    break
                k -= 1
            if k > 0:
                generic, end = end, len(t[:k].rstrip())
                if t[end - 2 : end] == "::":  # Rust's turbofish
                    end -= 2
        if not end or not (_NAME_BACK.match(t[end - 1]) or t[end - 1] in ")]"):
            continue
        start = _callee_start(f, end)
        if start >= end or t[start] in "0123456789" or t[end - 1] == '"':
            continue
        if t[start] == '"' and (k := bisect_right(f.strings, (start, len(t))) - 1) >= 0:
            start = f.strings[k][0]  # a method of a string
        if any(a < start < b for a, b in types):
            continue
        if re.fullmatch(r"\s*[(\[].*[)\]]\s*", t[start:end], re.S) and start in f.pair and f.pair[start] == end - 1:
            continue
        last_name = re.search(r"[\w$]+\s*$", t[start:end])
        if start in named or (last_name and start + last_name.start() in named):
            continue
        first = re.match(r"[\w$]+", t[start:end])
        word = first[0] if first else ""
        whole = t[start:end].strip()
        if whole == "async" and language in _JS_LIKE and re.match(r"\s*(?::[^;{}]*?)?=>", t[f.pair.get(at, at) + 1 :][:200]):
            continue
        if language in ("kotlin", "swift") and whole in _ACCESSORS and re.match(r"[^{}=;\n]*[{=]", t[f.pair.get(at, at) + 1 :][:200]):
            continue
        if (whole in _NOT_CALLED and (whole, language) != ("with", "kotlin")) or (word in ("if", "while", "for", "switch", "return") and word == whole):
            continue
        before = re.search(r"([\w$]+|[*&>\]])\s*$", t[max(0, start - 80) : start])
        prior = before[1] if before else ""
        if prior in _DEFINERS:
            continue
        if prior == "new":
            text = f.source[start : generic or end].strip()
            out.append((start - len(before[0]) if before else start, at, text))
            continue
        if language in ("java", "c", "cpp", "c_sharp") and prior and prior not in _BEFORE_CALL and (prior not in "*&>]" or (language in ("c", "cpp") and prior in "*&>" and _typed(t, start, before))):
            continue  # a type before a name: a declaration
        close = f.pair.get(at)
        if language in _BRACED_DEFINITION and close is not None and "." not in whole and re.match(r"\s*(?::[^{};=]*?)?\{", t[close + 1 : close + 120]) and prior not in ("return", "new"):
            continue  # a definition within an expression or a body
        if language == "java" and whole in ("this", "super"):
            continue
        out.append((start, -at, f.source[start:end].strip()))
    if language in ("kotlin", "swift"):
        out += _lambda_calls(f)
    if language in _JS_LIKE:
        for m in re.finditer(r"\bnew\s+([\w$.]+)(?![\w$.]|\s*[(<])", t):
            out.append((m.start(), 0, f.source[m.start(1) : m.end(1)]))
    found = []
    for start, _, text in sorted(out, key=lambda x: (x[0], x[1])):
        row = f.row(start)
        found.append((text, row + 1, f.lines[row].strip() if row < len(f.lines) else text))
    return found


def _typed(t: str, start: int, before) -> bool:
    """Whether a * & or > before a name belongs to a type: a name stands before it, at the start of a statement."""
    head = re.split(r"[;{}]", t[max(0, start - 200) : start])[-1]
    return bool(re.fullmatch(r"\s*(?:[\w:]+\s*)+(?:<[^<>]*>)?\s*[*&]*\s*", head)) and not re.match(r"\s*(?:return|else|throw|case|delete)\b", head)
