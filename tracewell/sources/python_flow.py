"""Raw facts of where values go in Python sources, beside those of ``python_sources``: one parse gives both.

A slot is a place that holds a value: an expression (by its place), a variable (scope$name), a function's result (id$<return>). Rows of fact ``flow`` say
what a slot takes: name (a dotted name), call (of a dotted name), attr and mcall (an attribute, or the result of a method, of the slot in ``extra``), copy (of the slot in ``extra``), self (the
class in ``value`` or one below it), none, or open. Others: param (a function's parameter, its place or none, its default's slot), site (an argument: its place, =name or *), write (of an attribute: the base's slot, or the class in ``id``
where it is self), receiver (a method call: its slot, and its base's), use (a name that is read without being called) and mention (a word of a short string).
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame

from tracewell.sources.python_sources import NOWHERE, Reader, bound_names, dotted, facts

MENTION = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:[.:][A-Za-z_][A-Za-z0-9_]*)*\Z")
MOST_MENTIONED = 512  # characters of a string that may name a definition
KEPT_AS_IS = ("staticmethod", "classmethod")


def variable(scope: str, name: str) -> str:
    return f"{scope}${name}"


RESULT = "<return>"


class FlowReader(Reader):
    def __init__(self, path: str, lines: list[bytes]):
        super().__init__(path, lines)
        self.done: set[str] = set()
        self.values: dict[int, ast.AST | None] = {}
        self.selves: dict[str, tuple[str, str]] = {}  # method -> its first parameter, its class
        self.called: set[int] = set()
        self.said: set[str] = set()

    def tell(self, fact: str, node: ast.AST, id: str | None, name: str | None = None, value: str | None = None, extra: str | None = None, named: str | None = None) -> None:
        self.rows.append((self.path, fact, id, name, value, extra, self.count, getattr(node, "lineno", None), getattr(node, "col_offset", -1) + 1 or None, self.space_of(named) if named else None))
        self.count += 1

    def visit_Module(self, node) -> None:
        for x in ast.walk(node):
            targets, value = (x.targets, x.value) if isinstance(x, ast.Assign) else ([x.target], x.value) if isinstance(x, (ast.AnnAssign, ast.NamedExpr)) else ([], None)
            for t in targets:
                self.values[id(t)] = value
            # classes that are named here aren't handed on
            asked = x.args[1:] if isinstance(x, ast.Call) and dotted(x.func) in ("isinstance", "issubclass") else x.bases if isinstance(x, ast.ClassDef) else [getattr(x, k, None) for k in ("annotation", "returns")] + ([x.type] if isinstance(x, ast.ExceptHandler) else [])
            self.called.update(id(n) for a in asked if a is not None for n in ast.walk(a))
        super().visit_Module(node)

    def slot(self, e: ast.AST) -> str:
        return f"{self.path}:{e.lineno}:{e.col_offset}-{e.end_lineno}:{e.end_col_offset}:{type(e).__name__}"

    def flow(self, e: ast.AST) -> str:
        """The slot of an expression; what it takes is told once."""
        slot = self.slot(e)
        if slot in self.done:
            return slot
        self.done.add(slot)
        parts = {ast.IfExp: lambda: [e.body, e.orelse], ast.BoolOp: lambda: e.values, ast.NamedExpr: lambda: [e.value]}.get(type(e))
        if parts:
            for x in parts():
                self.tell("flow", e, slot, "copy", None, self.flow(x))
        elif isinstance(e, ast.Constant) and e.value is None:
            self.tell("flow", e, slot, "none")
        elif isinstance(e, ast.Name):
            own = self.selves.get(self.space_of(e.id) or "")
            if own and own[0] == e.id:
                self.tell("flow", e, slot, "self", own[1])
            else:
                self.tell("flow", e, slot, "name", e.id, named=e.id)
        elif isinstance(e, ast.Attribute):
            self.tell("flow", e, slot, "attr", e.attr, self.flow(e.value))
            if dotted(e):
                self.tell("flow", e, slot, "name", dotted(e), named=dotted(e))
        elif isinstance(e, ast.Call) and (dotted(e.func) or isinstance(e.func, ast.Attribute)):
            if dotted(e.func):
                self.tell("flow", e, slot, "call", dotted(e.func), named=dotted(e.func))
            if isinstance(e.func, ast.Attribute):
                self.tell("flow", e, slot, "mcall", e.func.attr, self.flow(e.func.value))
        else:
            self.tell("flow", e, slot, "open")
        return slot

    def enter(self, where: str, body: list[ast.AST], taken: set[str], is_class: bool = False) -> None:
        super().enter(where, body, taken, is_class)
        for name, nodes in sorted(bound_names(body).items()):
            for node in nodes:
                if isinstance(node, ast.Assign):
                    self.tell("flow", node, variable(where, name), "copy", None, self.flow(node.value))
                elif isinstance(node, ast.Name) and id(node) in self.values:
                    value = self.values[id(node)]
                    if value is not None:
                        self.tell("flow", node, variable(where, name), "copy", None, self.flow(value))
                elif not isinstance(node, (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    self.tell("flow", node, variable(where, name), "open")

    def define(self, node, kind: str) -> None:
        here = f"{self.path}#{'.'.join([*self.scope, node.name])}"
        if kind != "class":
            a = node.args
            plain = [dotted(d) for d in node.decorator_list]
            places = [*a.posonlyargs, *a.args]
            if kind == "method" and "staticmethod" not in plain and places:
                first, places = places[0], places[1:]
                if first.arg not in bound_names(node.body) and "classmethod" not in plain:
                    self.selves[here] = (first.arg, self.here())
                else:
                    self.tell("flow", node, variable(here, first.arg), "open")
            given = dict(zip([x.arg for x in places][::-1], a.defaults[::-1], strict=False)) | {x.arg: d for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None}
            for k, x in enumerate(places):
                self.tell("param", node, here, x.arg, str(k), self.flow(given[x.arg]) if x.arg in given else None)
            for x in a.kwonlyargs:
                self.tell("param", node, here, x.arg, None, self.flow(given[x.arg]) if x.arg in given else None)
            for x in (a.vararg, a.kwarg):
                if x:
                    self.tell("flow", node, variable(here, x.arg), "open")
            own = [n for x in node.body for n in _own(x)]
            odd = isinstance(node, ast.AsyncFunctionDef) or any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in own)
            self.tell("flow", node, variable(here, RESULT), "open" if odd or any(p not in KEPT_AS_IS for p in plain) else "none")
        elif node.keywords:
            self.tell("mention", node, self.here(), node.name)  # a metaclass, or what a base makes of keywords, may construct it
        super().define(node, kind)

    def visit_Return(self, node) -> None:
        if node.value is not None:
            self.tell("flow", node, variable(self.here(), RESULT), "copy", None, self.flow(node.value))
        self.generic_visit(node)

    def visit_Global(self, node) -> None:
        for name in node.names:
            self.tell("flow", node, variable(self.module, name), "open")

    def visit_Nonlocal(self, node) -> None:
        for name in node.names:
            for where, names, is_class in self.spaces[:-1]:
                if name in names and not is_class:
                    self.tell("flow", node, variable(where, name), "open")

    def visit_Call(self, node) -> None:
        name, slot = dotted(node.func), self.flow(node)
        self.called.add(id(node.func))
        if isinstance(node.func, ast.Attribute) and not (name or "").startswith("super()."):
            self.tell("receiver", node, self.here(), node.func.attr, slot, self.flow(node.func.value))
        self.tell("site", node, slot, name, None, None, named=name)
        for k, a in enumerate(node.args):
            self.tell("site", node, slot, name, "*" if isinstance(a, ast.Starred) else str(k), None if isinstance(a, ast.Starred) else self.flow(a), named=name)
        for k in node.keywords:
            self.tell("site", node, slot, name, f"={k.arg}" if k.arg else "*", self.flow(k.value) if k.arg else None, named=name)
        if name == "setattr" and len(node.args) == 3 and isinstance(node.args[1], ast.Constant) and isinstance(node.args[1].value, str):
            self.written(node, node.args[0], node.args[1].value, node.args[2])
        super().visit_Call(node)

    def written(self, node: ast.AST, base: ast.AST, attr: str, value: ast.AST | None) -> None:
        own = self.selves.get(self.space_of(base.id) or "") if isinstance(base, ast.Name) else None
        mine = own[1] if own and own[0] == base.id else None
        self.tell("write", node, mine, attr, None if mine else self.flow(base), self.flow(value) if value is not None else None)

    def visit_Attribute(self, node) -> None:
        if not isinstance(node.ctx, ast.Load):
            if self.values.get(id(node), node) is not None:  # a bare annotation writes nothing
                self.written(node, node.value, node.attr, self.values.get(id(node)))
        elif id(node) not in self.called and dotted(node):
            self.tell("use", node, self.here(), dotted(node), named=dotted(node))
        if not dotted(node):
            self.generic_visit(node)

    def visit_Name(self, node) -> None:
        if isinstance(node.ctx, ast.Load) and id(node) not in self.called and self.space_of(node.id) != NOWHERE:
            self.tell("use", node, self.here(), node.id, named=node.id)

    def visit_Constant(self, node) -> None:
        if isinstance(node.value, str) and len(node.value) <= MOST_MENTIONED and MENTION.match(node.value):
            for word in set(re.split("[.:]", node.value)) - self.said:
                self.said.add(word)
                self.tell("mention", node, self.here(), word)


def _own(node: ast.AST):
    """The nodes of a statement, without those of functions and classes inside."""
    yield node
    if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
        for x in ast.iter_child_nodes(node):
            yield from _own(x)


def flow_facts(files: DataFrame) -> DataFrame:
    """All raw facts of ``files`` (path, content), with those of this module."""
    return facts(files, FlowReader)
