"""Raw facts of how texts are put together in Python sources, beside those of ``python_sources``: one parse gives both.

A node is an expression that makes a text. Its text-node row has its kind as name: join (parts one after the other), percent or keyed (the % operator with values by
position or by name) or format (str.format). Its parts are rows of their own with the node as id, in order of place: part-text (literal), part-name (a dotted name, with its
scope), part-inner (another node) and part-value (anything else); extra is the place in a template that the part goes to, or TEMPLATE. Rows of fact ``text`` tell what a node is for: a name
that is bound once in the scope ``id`` (as =name), or an argument of the call, or of what a call makes for a name, whose row's place ``id`` gives. What may bind a name
once more is a rewritten row (of the scope ``id``, or of any if it is empty) or a namespace row (all names of the file's module).
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame

from tracewell.sources.python_sources import Reader, bound_names, dotted, facts

TEMPLATE = "<template>"
ASKED = ("url", "base_url")  # keywords whose texts are told


def is_format(e: ast.AST) -> bool:
    return isinstance(e, ast.Call) and isinstance(e.func, ast.Attribute) and e.func.attr == "format"


def is_percent(e: ast.AST) -> bool:
    return isinstance(e, ast.BinOp) and isinstance(e.op, ast.Mod)


class TextReader(Reader):
    def __init__(self, path: str, lines: list[bytes]):
        super().__init__(path, lines)
        self.nodes: dict[int, str] = {}
        self.annotated: dict[int, ast.AST] = {}

    def tell(self, fact: str, id: str, name: str | None = None, value: str | None = None, extra: str | None = None) -> None:
        self.rows.append((self.path, fact, id, name, value, extra, self.count, None, None, self.space_of(name) if fact == "part-name" else None))
        self.count += 1

    def flat(self, e: ast.AST) -> list[tuple[str, object]]:
        """The parts that an expression puts one after the other."""
        out: list[tuple[str, object]] = []
        todo = [e]
        while todo:
            x = todo.pop()
            if isinstance(x, ast.Constant) and isinstance(x.value, str):
                out.append(("part-text", x.value))
            elif isinstance(x, ast.JoinedStr):
                todo += reversed(x.values)
            elif isinstance(x, ast.FormattedValue) and x.format_spec is None and x.conversion in (-1, ord("s")):
                todo.append(x.value)
            elif isinstance(x, ast.BinOp) and isinstance(x.op, ast.Add):
                todo += [x.right, x.left]
            elif is_percent(x) or is_format(x):
                out.append(("part-inner", x))
            elif isinstance(x, (ast.Name, ast.Attribute)) and dotted(x):
                out.append(("part-name", dotted(x)))
            else:
                out.append(("part-value", None))
        return out

    def node(self, e: ast.AST) -> str:
        """The node of an expression; its parts are told once."""
        if id(e) not in self.nodes:
            key = self.nodes[id(e)] = f"{self.path}:{self.count}"
            if is_percent(e):
                kind, given = "keyed" if isinstance(e.right, ast.Dict) else "percent", [(TEMPLATE, e.left), *self.operands(e.right)]
            elif is_format(e):
                starred = any(isinstance(x, ast.Starred) for x in e.args) or any(k.arg is None for k in e.keywords)
                named = [*((str(i), x) for i, x in enumerate(e.args)), *((k.arg, k.value) for k in e.keywords)]
                kind, given = "format", [(TEMPLATE, e.func.value), *([] if starred else named)]
            else:
                kind, given = "join", []
            self.tell("text-node", key, kind)
            parts = [(None, p) for p in self.flat(e)] if kind == "join" else [(slot, self.one(x)) for slot, x in given]
            for slot, (fact, what) in parts:
                inner = self.node(what) if fact == "part-inner" else None
                self.tell(fact, key, what if fact == "part-name" else None, inner or (what if fact == "part-text" else None), slot)
        return self.nodes[id(e)]

    def one(self, e: ast.AST) -> tuple[str, object]:
        parts = self.flat(e)
        return parts[0] if len(parts) == 1 else ("part-inner", e)

    def operands(self, e: ast.AST) -> list[tuple[str, ast.AST]]:
        """What the % operator is given, by name or by position; nothing where it can't be told."""
        if isinstance(e, ast.Dict):
            known = all(isinstance(k, ast.Constant) and isinstance(k.value, str) for k in e.keys)
            return list({k.value: (k.value, v) for k, v in zip(e.keys, e.values, strict=True)}.values()) if known else []
        given = e.elts if isinstance(e, ast.Tuple) else [e]
        return [] if any(isinstance(x, ast.Starred) for x in given) else [(str(i), x) for i, x in enumerate(given)]

    def told(self, where: str, role: str, e: ast.AST | None) -> None:
        if e is not None and any(fact != "part-value" for fact, _ in self.flat(e)):
            self.tell("text", where, role, self.node(e))

    def put(self, fact: str, node: ast.AST, *args, **kwargs) -> None:
        place = self.count
        super().put(fact, node, *args, **kwargs)
        if fact in ("call", "made") and isinstance(node, ast.Call):
            for i, x in enumerate(node.args[:2]):
                self.told(f"{self.path}:{place}", str(i), x)
            for k in node.keywords:
                if k.arg in ASKED:
                    self.told(f"{self.path}:{place}", k.arg, k.value)

    def enter(self, where: str, body: list[ast.AST], taken: set[str], is_class: bool = False) -> None:
        super().enter(where, body, taken, is_class)
        for name, nodes in sorted(bound_names(body).items()):
            if len(nodes) == 1 and name not in taken:
                self.told(where, f"={name}", nodes[0].value if isinstance(nodes[0], ast.Assign) else self.annotated.get(id(nodes[0])))

    def visit_Module(self, node) -> None:
        self.annotated = {id(x.target): x.value for x in ast.walk(node) if isinstance(x, ast.AnnAssign) and x.value is not None}
        super().visit_Module(node)

    def visit_Global(self, node) -> None:
        for name in node.names:
            self.tell("rewritten", self.module, name)

    def visit_Nonlocal(self, node) -> None:
        for name in node.names:
            self.tell("rewritten", self.space_of(name) or "", name)

    def visit_Attribute(self, node) -> None:
        if not isinstance(node.ctx, ast.Load) and dotted(node.value) not in ("self", "cls"):
            self.tell("rewritten", "", node.attr)
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        name = dotted(node.func)
        if name in ("setattr", "delattr") and len(node.args) > 1 and isinstance(node.args[1], ast.Constant):
            self.tell("rewritten", "", str(node.args[1].value))
        if name == "globals" or (name in ("vars", "locals") and not self.scope):
            self.tell("namespace", self.module)
        super().visit_Call(node)


def text_facts(files: DataFrame) -> DataFrame:
    """Raw facts of ``files`` (path, content) with those of texts."""
    return facts(files, TextReader)
