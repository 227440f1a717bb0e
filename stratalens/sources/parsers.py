"""Parsers: bytes of one file to (path, lang, sha256, line_count, symbols, edges).

PARSERS maps suffixes to functions text -> (line count, symbols, edges) and may be added to. Python and Markdown are
complete; DOCX needs the standard library only; the brace languages are in braces.py. String contents never enter a
signature.
"""

from __future__ import annotations

import ast
import hashlib
import io
import os
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from stratalens.functions.text import OPAQUE, SECRET_SHAPES
from stratalens.sources.braces import script, typed

_SECRETS, _OPAQUE = re.compile("|".join(SECRET_SHAPES)), re.compile(OPAQUE)
VALUE_CHARS, DOC_CHARS = 60, 160


def redacted(text: str, opaque: bool = True) -> str:
    out = _SECRETS.sub("<redacted>", text)
    return _OPAQUE.sub("<redacted>", out) if opaque else out


def _short(text: str, most: int) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[:most] + "…"


class _Masked(ast.NodeTransformer):
    """Text literals give way to the name of their type."""

    def visit_Constant(self, node):
        kind = {str: "<str>", bytes: "<bytes>"}.get(type(node.value))
        return ast.copy_location(ast.Name(kind, ast.Load()), node) if kind else node


def _shown(node: ast.AST) -> str:
    return ast.unparse(_Masked().visit(ast.parse(ast.unparse(node), mode="eval").body))


_CONTAINERS = {ast.List: "<list>", ast.Tuple: "<tuple>", ast.Set: "<set>", ast.Dict: "<dict>"}


def _literal(node: ast.AST) -> bool:
    if isinstance(node, ast.UnaryOp):
        return isinstance(node.op, (ast.UAdd, ast.USub)) and _literal(node.operand)
    if isinstance(node, ast.Dict):
        return None not in node.keys and all(map(_literal, [*node.keys, *node.values]))
    return isinstance(node, ast.Constant) or isinstance(node, (ast.List, ast.Tuple, ast.Set)) and all(map(_literal, node.elts))


def _value(node: ast.AST) -> str:
    texts = [type(x.value) for x in ast.walk(node) if isinstance(x, ast.Constant) and isinstance(x.value, (str, bytes))]
    if not texts:
        return _short(ast.unparse(node), VALUE_CHARS)
    return _CONTAINERS.get(type(node)) or ("<bytes>" if texts[0] is bytes else "<str>")


def _target(node: ast.AST) -> str | None:
    """The dotted name that a call or a base goes by; of a chain on something else, its last attribute."""
    chain = []
    while isinstance(node, ast.Attribute):
        chain.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(chain)])
    return chain[0] if chain else None


def _def_line(node) -> str:
    args = ast.parse(f"def f({ast.unparse(node.args)}): pass").body[0].args
    for group in (args.defaults, args.kw_defaults):
        group[:] = [d and (ast.Name(_value(d)) if _literal(d) else _Masked().visit(d)) for d in group]
    for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg]:
        if a is not None and a.annotation is not None:
            a.annotation = _Masked().visit(a.annotation)
    way = f" -> {_shown(node.returns)}" if node.returns else ""
    return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(args)}){way}"


def _enum(node: ast.ClassDef) -> bool:
    last = [(_target(b) or "").rpartition(".")[2] for b in node.bases]
    return any(x in ("Flag", "IntFlag") or x.endswith("Enum") for x in last)


def python(text: str):
    lines = text.count("\n") + 1
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return lines, [], []
    symbols, edges = [], []
    # (node, qualified name of what it stands in, is that a class, an enum, a function)
    todo = [(n, "", "module") for n in reversed(tree.body)]
    while todo:
        node, inside, where = todo.pop()
        owner, line = inside or "<module>", getattr(node, "lineno", 0)
        name = lambda n: f"{inside}.{n}" if inside else n  # noqa: E731, B023
        within = (inside, where)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            within = (name(node.name), "function")
            symbols.append((within[0], "method" if inside else "function", line, _def_line(node), node.end_lineno))
        elif isinstance(node, ast.ClassDef):
            within = (name(node.name), "enum" if _enum(node) else "class")
            bases = ", ".join(map(_shown, node.bases)) + "".join(f"{', ' * bool(node.bases or i)}{k.arg}={_shown(k.value)}" for i, k in enumerate(node.keywords) if k.arg)
            symbols.append((within[0], "class", line, f"class {node.name}({bases})" if bases else f"class {node.name}", node.end_lineno))
            edges += [(within[0], t, "inherit", line) for t in map(_target, node.bases) if t]
        elif isinstance(node, ast.Call):
            if t := _target(node.func):
                edges += [(owner, x, "call", line) for x in dict.fromkeys((t, t.rpartition(".")[2]))]
        elif isinstance(node, ast.Import):
            edges += [(owner, a.name, "import", line) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            edges += [(owner, ".".join(filter(None, (node.module, a.name))), "import", line) for a in node.names]
        elif isinstance(node, ast.Assign) and where != "function" and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and _literal(node.value):
            n = node.targets[0].id
            symbols.append((name(n), "enum_member" if where == "enum" else "constant", line, f"{n} = {_value(node.value)}", node.end_lineno))
        elif isinstance(node, ast.AnnAssign) and where != "function" and isinstance(node.target, ast.Name):
            n, value = node.target.id, node.value if node.value is not None and _literal(node.value) else None
            tail = f" = {_value(value)}" if value is not None else ""
            if where != "module":
                symbols.append((name(n), "enum_member" if where == "enum" else "attribute", line, f"{n}: {_short(_shown(node.annotation), VALUE_CHARS)}{tail}", node.end_lineno))
            elif value is not None:
                symbols.append((n, "constant", line, f"{n}{tail}", node.end_lineno))
        todo += [(c, *within) for c in reversed(list(ast.iter_child_nodes(node)))]
    code = {s[0] for s in symbols if s[1] in ("function", "method", "class")}
    symbols = [s for s in symbols if s[1] in ("function", "method", "class") or s[0] not in code]
    first = next((x.strip() for x in (ast.get_docstring(tree) or "").splitlines() if x.strip()), None)
    if first:
        symbols.insert(0, ("<module>", "module_doc", 1, _short(first, DOC_CHARS), None))
    return lines, symbols, edges


_FENCE, _ATX = re.compile(r" {0,3}(`{3,}|~{3,})"), re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*$")


def headings(lines: list[str]) -> list[tuple[int, str, int]]:
    """(level, label, line) outside of fenced blocks; a fence ends at one of the same sign, no shorter."""
    out, fence = [], ""
    for n, text in enumerate(lines, 1):
        if m := _FENCE.match(text):
            if not fence:
                fence = m[1]
            elif m[1].startswith(fence):
                fence = ""
        elif not fence and (m := _ATX.match(text)):
            out.append((len(m[1]), m[2].strip(), n))
    return out


def sections(heads: list[tuple[int, str, int]], total: int):
    """Section symbols: each to the line before the next heading of no deeper level; names made unique."""
    out, taken, open_ = [], set(), []
    ends = [total] * len(heads)
    for i, (level, _, line) in enumerate(heads):
        while open_ and heads[open_[-1]][0] >= level:
            j = open_.pop()
            ends[j] = max(heads[j][2], line - 1)
        open_.append(i)
    for (level, label, line), end in zip(heads, ends):
        label = redacted(label, opaque=False)
        name = base = label or f"section-{line}"
        k = 2
        while name in taken:
            name, k = f"{base} #{k}", k + 1
        taken.add(name)
        out.append((name, "section", line, f"{'#' * level} {label}", end))
    return out


def markdown(text: str):
    lines = text.splitlines()
    return len(lines), sections(headings(lines), len(lines)), []


def outline(heads: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """(level, label, line) of a document's outline in line order; of equal lines the order they came in."""
    return sorted(heads, key=lambda h: h[2])


def paged(pages: list[str], heads: list[tuple[int, str, int]]):
    """A document of pages, its outline given as (level, label, page index): lines run on over the pages."""
    starts, lines = [], []
    for text in pages:
        starts.append(len(lines) + 1)
        lines += text.splitlines()
    placed = outline([(level, label, starts[i]) for level, label, i in heads if 0 <= i < len(starts)])
    return len(lines), sections(placed, len(lines)), []


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_lines(content: bytes) -> tuple[list[str], list[tuple[int, str, int]]]:
    """(a line for each paragraph, headings) of a DOCX file: the paragraphs of the body whose style is named 'Heading N'."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else ElementTree.Element("none")
    named = {x.get(f"{_W}styleId"): (x.find(f"{_W}name").get(f"{_W}val") or "") for x in styles.iter(f"{_W}style") if x.find(f"{_W}name") is not None}
    text_of = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda x: "\t", f"{_W}br": lambda x: " ", f"{_W}cr": lambda x: " "}
    lines, heads = [], []
    for p in body.findall(f"{_W}p") if body is not None else []:
        text = re.sub("[\r\n]", " ", "".join(text_of[x.tag](x) for r in p.iter(f"{_W}r") for x in r if x.tag in text_of))
        lines.append(text)
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = named.get(style.get(f"{_W}val"), "") if style is not None else ""
        if name.lower().startswith("heading "):  # files store the built-in style in lower case
            level = name.split()[1] if len(name.split()) > 1 else ""
            heads.append((int(level) if level.isdigit() else 1, text.strip() or f"section-{len(lines)}", len(lines)))
    return lines, heads


def docx(content: bytes):
    """Sections of a DOCX file; one that cannot be read has no line."""
    try:
        lines, heads = docx_lines(content)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return 0, [], []
    return len(lines), sections(heads, len(lines)), []


def docx_text(content: bytes) -> str:
    """The text that range reads of a DOCX file see: one line a paragraph, without secrets."""
    try:
        return redacted("\n".join(docx_lines(content)[0]), opaque=False)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""


def function_doc(text: str | None, qualified: str, most: int = 200) -> str | None:
    """The first line of the docstring of a function or class by its dotted name; null where there is none."""
    try:
        node = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return None
    for part in qualified.split("."):
        node = next((x for x in getattr(node, "body", []) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and x.name == part), None)
        if node is None:
            return None
    first = next((x.strip() for x in (ast.get_docstring(node) or "").splitlines() if x.strip()), "")
    return redacted(first)[:most] or None


#: Labels of suffixes.
LANGS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".md": "markdown", ".pdf": "pdf", ".docx": "docx",
}
READERS = {"python": python, "markdown": markdown, "javascript": script, "typescript": script, "java": typed("java"), "c": typed("c"), "cpp": typed("cpp")}
#: Headers are read as C++, which takes C's declarations too.
PARSERS: dict[str, Callable] = {s: READERS["cpp" if s == ".h" else lang] for s, lang in LANGS.items() if lang in READERS}
#: Parsers that take the bytes of a file.
BINARY: dict[str, Callable] = {".docx": docx}


def parse(path: str, content: bytes) -> tuple:
    """The row of one file; a suffix without a parser gives the file alone. The longest matching suffix decides."""
    ends = max((s for s in (*PARSERS, *BINARY) if path.endswith(s)), key=len, default=None)
    if ends in BINARY:
        lines, symbols, edges = BINARY[ends](content)
    else:
        text = content.decode("utf-8", "replace")
        lines, symbols, edges = PARSERS[ends](text) if ends else (text.count("\n") + 1, [], [])
    symbols = [{"name": n, "kind": k, "line": a, "signature": redacted(s, opaque=k != "section") if s else s, "end_line": e} for n, k, a, s, e in symbols]
    edges = [{"from_name": f, "to_name": redacted(t), "kind": k, "line": a} for f, t, k, a in edges]
    last = os.path.splitext(path)[1]
    return path, LANGS.get(ends) or LANGS.get(last) or last[1:] or "?", hashlib.sha256(content).hexdigest(), lines, symbols, edges
