"""Declarations, calls and imports of code, by a scanner that knows each language's strings, comments, brackets and indentation.

Files are rows and are scanned where Spark deals them; all facts of a file come from one pass over it.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import spread

ROWS = 4096  # facts that leave a task at once
FACTS = "uri string, fact string, name string, kind string, label string, start_line int, end_line int, doc_line int, signature string, context string, module string"
LANGUAGES = {"py": "python", "pyi": "python", "js": "script", "jsx": "script", "mjs": "script", "ts": "script", "tsx": "script", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "sol": "solidity"}
CLASSES = {"class", "struct", "interface", "trait", "enum", "contract", "library", "record", "object", "union", "namespace", "impl", "type"}
_STRINGS = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?"
_SLASHES = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|"
TEXTS = {  # what is no code: comments first, then strings
    "python": r"(?P<comment>#[^\n]*)|(?:\"\"\"|''')(?:\\.|[^\\])*?(?:\"\"\"|'''|\Z)|" + _STRINGS,
    "script": _SLASHES + _STRINGS + r"|`(?:\\.|[^`\\])*`?",
    "go": _SLASHES + r'"(?:\\.|[^"\\\n])*"?|`[^`]*`?|' + r"'(?:\\.|[^'\\\n])'",
    "rust": _SLASHES + r'r(#*)".*?"\2|"(?:\\.|[^"\\])*"?|' + r"'(?:\\[^\n]{1,9}?|[^'\\\n])'",
}
# What stands before the bracket of a declaration's body: (kind, name) groups, or the name alone; by language.
_TYPED = r"\b(?P<kind>class|interface|enum|record|struct|union|namespace|object)\s+(?P<name>[\w$]+)[^;()=]*$"
_METHOD = r"(?P<name>[\w$~#]+)\s*(?:<[^<>]*>)?\s*\((?P<args>[^;]*)\)\s*(?:(?:const|noexcept|override|final)\s*)*(?:throws\s[^;{}]*|->[^;{}]*|:[^;{}=]*)?$"
HEADS = {
    "script": [_TYPED, r"\b(?P<kind>function)\b\s*\*?\s*(?P<name>[\w$]+)\s*[<(].*$", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:<[^<>]*>\s*)?(?:\(.*\)|[\w$]+)\s*(?::[^=;]+)?=>\s*$", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s+)?function\b.*$"],
    "go": [r"\bfunc\s*(?:\([^()]*\)\s*)?(?P<name>\w+)\s*[\[(].*$", r"\btype\s+(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?(?P<kind>struct|interface)\s*$"],
    "rust": [r"\b(?P<kind>fn)\s+(?P<name>\w+).*$", r"\b(?P<kind>struct|enum|trait|union)\s+(?P<name>\w+)[^;]*$", r"\b(?P<kind>impl)\b\s*(?:<.*?>\s*)?(?:[^;{}]*\bfor\s+)?(?P<name>\w+)[^;]*$"],
    "java": [_TYPED],
    "kotlin": [_TYPED.replace("[^;()=]*$", ".*$"), r"\b(?P<kind>fun)\s+(?:<[^<>]*>\s*)?(?:[\w.]+\.)?(?P<name>\w+)\s*\(.*$"],
    "c": [_TYPED],
    "solidity": [r"\b(?P<kind>contract|interface|library|struct|enum)\s+(?P<name>\w+)[^;()]*$", r"\b(?P<kind>function|modifier)\s+(?P<name>\w+).*$"],
}
HEADS = {k: [re.compile(x, re.S) for x in v] for k, v in HEADS.items()}
METHOD = re.compile(_METHOD, re.S)
INSIDE_CLASSES, ANYWHERE = {"script", "java"}, {"c"}  # where a name, its arguments and a body make a declaration
CONTROL = set("if for while switch catch return function do else try new await typeof sizeof throw case in of not and or elif except lambda assert yield del raise super this self import".split())
WORDS = {"go": {"func", "go", "defer", "select", "range", "chan", "map"}, "rust": {"match", "pub", "fn", "impl"}, "script": {"async", "require"}, "python": {"with", "print", "exec"}, "java": {"synchronized"}}  # of one language alone
BODILESS = {"script": re.compile(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:const|let|var)[ \t]+(?P<name>[\w$]+)[ \t]*(?::[^=;\n]+)?=[ \t]*(?:async[ \t]*)?(?:\([^\n()]*\)|[\w$]+)[ \t]*=>[ \t]*(?=[^\s{])[^\n]*", re.M),
            "rust": re.compile(r"^[ \t]*(?:pub(?:\([^()]*\))?[ \t]+)?(?P<kind>struct)[ \t]+(?P<name>\w+)[^;{}\n]*;", re.M)}
BLOCK = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)
CALL = re.compile(r"(?<![\w$.])(?:[\w$]+[ \t]*(?:\.|::|->)[ \t]*)*([A-Za-z_$][\w$]*)[ \t]*\(")
DECLARING = re.compile(r"\b(?:def|function|func|fn|fun|class|modifier)\s*\*?\s*(?:\([^()]*\)\s*)?$")
PY_FROM, PY_IMPORT = re.compile(r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^()]*\)|[^\n]*)", re.M), re.compile(r"^[ \t]*import[ \t]+([^\n]+)", re.M)
ES_IMPORT = re.compile(r"""\b(?:import|export)\b(?:\s+type\b)?(?P<names>[\w\s$*{},]*?)(?:\bfrom\s*)?(?P<q>['"])(?P<module>[^'"\n]+)(?P=q)|\brequire\(\s*(?P<r>['"])(?P<required>[^'"\n]+)(?P=r)""")
PATH_IMPORT = {"java": re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)", re.M), "kotlin": re.compile(r"^[ \t]*import\s+([\w.]+(?:\.\*)?)", re.M), "rust": re.compile(r"\buse\s+([\w:]+)", re.M), "go": re.compile(r"""(?m)^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"([\w./-]+)"[ \t]*$""")}


class Scan:
    """One file: its lines, its text without strings and comments (of the same length), and where whole-line comments stand."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.rows = text, language, text.split("\n")
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        out, at, self.comments = [], 0, []
        for m in re.finditer(TEXTS.get(language, TEXTS["script"].replace("|`(?:\\\\.|[^`\\\\])*`?", "")), text, re.S):
            out += [text[at:m.start()], re.sub(r"[^\n]", " ", m[0])]
            at = m.end()
            if m["comment"] is not None and not text[text.rfind("\n", 0, m.start()) + 1:m.start()].strip():
                self.comments.append((self.line(m.start()), self.line(m.end() - 1)))
        self.code = "".join([*out, text[at:]])

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def doc_line(self, start: int) -> int:
        """The first line of the comments that end right above a line, or above one blank line."""
        if self.language == "python":
            return start
        for first, last in reversed(self.comments):
            if last < start:
                if start - last > 2 or start - last == 2 and self.rows[last].strip():
                    break
                start = first
        return start

    def blocks(self) -> Iterator[tuple[str, str, int, int, int]]:
        """(kind, name, start, head's end, end) of declarations by indentation: to the last line that is deeper, or begins in open brackets."""
        heads = {self.line(m.start(2)): m for m in BLOCK.finditer(self.code)}
        remarks = {k for first, last in self.comments for k in range(first, last + 1)}
        open_: list[tuple[int, re.Match, int]] = []
        depth, last, at = 0, 0, 0
        for number, row in enumerate(self.code.split("\n"), 1):
            raw = self.text[at:at + len(row)]
            if depth == 0 and row.strip():
                indent = len(row) - len(row.lstrip())
                while open_ and open_[-1][0] >= indent:
                    _, m, _ = open_.pop()
                    yield m[2], m[3], m.start(), m.end(), last
                if number in heads:
                    open_.append((indent, heads[number], number))
            if raw.strip() and number not in remarks:
                last = number
            depth = max(0, depth + len(re.findall(r"[(\[{]", row)) - len(re.findall(r"[)\]}]", row)))
            at += len(row) + 1
        for _, m, _ in reversed(open_):
            yield m[2], m[3], m.start(), m.end(), last

    def braces(self) -> Iterator[tuple[str, str, int, int, int]]:
        """The same by brackets: a stack of open ones, and for each brace what stands before it."""
        stack: list[list] = []  # [bracket, where what stands before the next one begins, declaration]
        begin = 0
        for m in re.finditer(r"[(\[{}\])];|[(\[{}\])]|;", self.code):
            c = m[0][0]
            if c in "([{":
                found = self._head(begin, m.start(), stack) if c == "{" else None
                stack.append([c, begin, found])
                begin = m.end()
            elif c == ";":
                begin = m.end()
            elif stack:
                _, before, found = stack.pop()
                begin = m.end() if c == "}" else before
                if found:
                    yield *found, self.line(m.start())
                if m[0][1:] == ";":
                    begin = m.end()
        for _, _, found in reversed(stack):  # a file that ends within a body
            if found:
                yield *found, self.line(len(self.code.rstrip()))
        if form := BODILESS.get(self.language):
            for m in form.finditer(self.code):
                yield m.groupdict().get("kind") or "function", m["name"], m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), self.line(m.end() - 1)

    def _head(self, begin: int, at: int, stack: list[list]) -> tuple[str, str, int, int] | None:
        head = self.code[begin:at]
        for form in HEADS[self.language]:
            if found := list(form.finditer(head)):
                m = found[-1]
                return m.groupdict().get("kind") or "function", m["name"], begin + m.start(), at
        around = next((x[2] for x in reversed(stack) if x[2]), None)
        near = stack[-1][2] if stack else None
        if self.language in INSIDE_CLASSES and near and near[0] in CLASSES or self.language in ANYWHERE and (not around or near and near[0] in CLASSES):
            m = METHOD.search(head[-2000:])
            if m and m["name"] not in CONTROL and not re.search(r"(?:=|\bnew|\breturn)\s*[\w$.]*$", head[-2000:][:m.start("name")]):
                return "method", m["name"], begin + max(0, len(head) - 2000) + m.start("name"), at
        return None

    def declarations(self) -> list[tuple]:
        """(name, kind, label, start_line, end_line, doc_line, signature, context) in order of their lines; the context names those around."""
        out, around = [], []
        rows = sorted({(self.line(start), -end, start, kind, name, body) for kind, name, start, body, end in (self.blocks() if self.language == "python" else self.braces())})
        for first, last, start, kind, name, body in rows:
            while around and around[-1][0] < -last:
                around.pop()
            around.append((-last, name))
            begin = self.text.rfind("\n", 0, start) + 1
            said = self.text[begin:self._head_end(body)]
            signature = re.sub(r"\s*(?:[{:]|=>)\s*$", "", " ".join(said.split()))[:120]
            out.append((name, kind, "Class" if kind in CLASSES else "Function", first, -last, self.doc_line(first), signature, ".".join(n for _, n in around)))
        return out

    def _head_end(self, body: int) -> int:
        """Where a head ends: at its brace, or at the colon outside brackets of what is told by indentation."""
        if self.language != "python":
            return body
        depth = 0
        for i in range(body, len(self.code)):
            depth += (self.code[i] in "([{") - (self.code[i] in ")]}")
            if depth == 0 and self.code[i] == ":" or depth <= 0 and self.code[i] == "\n":
                return i
        return len(self.code)

    def calls(self, declared: set[tuple[int, str]]) -> Iterator[tuple[int, str]]:
        """(line, last name) of what a bracket follows, but for the names of declarations (line, name)."""
        words = CONTROL | WORDS.get(self.language, set())
        for m in CALL.finditer(self.code):
            if m[1] not in words and (self.line(m.start(1)), m[1]) not in declared and not DECLARING.search(self.code[max(0, m.start() - 80):m.start(1)]):
                yield self.line(m.start(1)), m[1]

    def imports(self) -> Iterator[tuple[str, str | None]]:
        """(module, local name that it binds, or none)."""
        if self.language == "python":
            for m in PY_FROM.finditer(self.code):
                yield m[1], None
                for part in m[2].strip("()").replace("\n", " ").split(","):
                    if names := part.split():
                        yield m[1], names[-1] if len(names) in (1, 3) and names[-1].isidentifier() else None
            for m in PY_IMPORT.finditer(self.code):
                for part in m[1].split(","):
                    if names := part.split():
                        yield names[0], names[-1] if len(names) == 3 else None
        elif self.language == "script":
            for m in ES_IMPORT.finditer(self.text):
                if self.code[m.start()] == self.text[m.start()]:
                    module = m["module"] or m["required"]
                    yield module, None
                    for part in re.split(r"[{},]", m["names"] or ""):
                        if (names := part.split()) and names[-1] not in ("type", "from", "*"):
                            yield module, names[-1]
        elif form := PATH_IMPORT.get(self.language):
            for m in form.finditer(self.text):
                if self.language == "go" or self.code[m.start(1)] == self.text[m.start(1)]:
                    yield m[1].strip(":").replace("::", "."), None


def facts(resources: DataFrame) -> DataFrame:
    """FACTS of code files (uri, content): rows of fact `declaration`, `call` (name, start_line) and `import` (module, name).

    Files of no known language, and null contents, have none. Line ends of all kinds count as one.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        types = [pa.int32() if c.endswith(" int") else pa.string() for c in FACTS.split(", ")]

        def batched(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        held: list[tuple] = []
        for batch in batches:
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                language = LANGUAGES.get((uri or "").rpartition(".")[2].lower())
                if not language or not content:
                    continue
                found = Scan(content.replace("\r\n", "\n").replace("\r", "\n"), language)
                declared = found.declarations()
                rows = [(uri, "declaration", *d, None) for d in declared]
                rows += [(uri, "call", name, None, None, at, at, None, None, None, None) for at, name in found.calls({(d[3], d[0]) for d in declared})]
                rows += [(uri, "import", name, None, None, None, None, None, None, None, module) for module, name in found.imports()]
                held += rows
                if len(held) >= ROWS:
                    yield batched(held)
                    held = []
        if held:
            yield batched(held)

    code = resources.filter(F.lower(F.element_at(F.split("uri", r"\.", -1), -1)).isin(list(LANGUAGES)))
    return spread(code.select("uri", F.col("content").cast("string").alias("content")), "uri").mapInArrow(each, FACTS)
