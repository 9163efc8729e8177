"""Code facts: one parse per Python file, flat rows out.

This is the only batch step that runs Python per row, because Spark has no Python grammar. The helper below
only describes what the syntax tree contains: calls, assignments, routers and decorated functions. Which of
that matters is decided by the column expressions of the rules and of the endpoint discovery.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade import session  # noqa: F401  (makes the helper below travel by value)
from palisade.catalog import markers

VALUE = (
    "struct<node:string, type:string, literal:string, dotted:string, callee:string, operator:string, "
    "strings:array<string>, entries:array<struct<key:string, literal:string>>>"
)
PLACE = "struct<line_start:int, line_end:int, column_start:int, column_end:int>"
DEPENDENCY = (
    "struct<expression:string, form:string, name:string, candidates:array<string>, scopes:array<string>, use_cache:string>"
)
PARAMETER = (
    "struct<name:string, slot:string, annotation:string, annotation_names:array<string>, annotation_nullable:boolean, "
    "annotation_source:string, default:string, has_default:boolean, default_none:boolean, marker:string, "
    "marker_args:boolean, marker_first:string, marker_first_type:string, description:string, alias:string, "
    "example:string, deprecated:string>"
)
ROUTE = (
    f"struct<verb:string, attribute:boolean, has_args:boolean, path_literal:string, path_text:string, path_keyword:string, "
    f"router_variable:string, router:struct<prefix:string, tags:array<string>, dependencies:array<{DEPENDENCY}>>, "
    f"tags:array<string>, summary:string, description:string, deprecated:string, response_model:string, status_code:int, "
    f"response_class:string, operation_id:string, dependencies:array<{DEPENDENCY}>, dependency_calls:array<struct<text:string, expression:string>>, "
    f"responses:array<struct<status:int, model:string, description:string>>, place:{PLACE}, evidence:string>"
)
FUNCTION = (
    f"struct<name:string, line:int, text:string, docstring:string, inside_route:boolean, routes:array<{ROUTE}>, "
    f"parameters:array<{PARAMETER}>, dependencies:array<{DEPENDENCY}>, dependency_calls:array<struct<text:string, expression:string>>, "
    f"calls:array<struct<name:string, first_name:string, linked:boolean, link_name:string, arg_names:array<string>, "
    f"unpacked:array<string>, place:{PLACE}, evidence:string>>, compares:array<array<string>>, "
    f"tests:array<struct<reads:array<struct<root:string, field:string>>, place:{PLACE}, evidence:string>>, "
    f"handler_uses:array<struct<place:{PLACE}, evidence:string>>, assigns:boolean, "
    f"exits:array<struct<form:string, callee:string, status:int, status_ref:string, detail:string>>>"
)
SCHEMA = (
    f"project_id string, relative_path string, kind string, seq int, place {PLACE}, function_name string, class_name string, "
    f"evidence string, in_signature boolean, error string, "
    f"call struct<callee:string, arg0:{VALUE}, arg1:{VALUE}, args:array<{VALUE}>, keywords:array<struct<name:string, value:{VALUE}>>>, "
    f"assign struct<names:array<string>, fields:array<string>, root:string, text:string, value:{VALUE}>, "
    f"router struct<variable:string, prefix:string, tags:array<string>, dependencies:array<{DEPENDENCY}>>, "
    f"function {FUNCTION}"
)

_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_ROWS_PER_BATCH = 1000
_TEXT_PER_BATCH = 16 << 20
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LISTS = (ast.List, ast.Tuple, ast.Set)


# Fields without nodes, or with nodes that only say how an operator or a name is meant and hold none themselves.
_LEAVES = {"ctx", "op", "ops", "id", "attr", "kind", "type_comment", "conversion", "is_async", "simple", "level", "lineno", "tag"}
_INNER: dict[type, tuple[str, ...]] = {ast.Constant: (), ast.Name: ()}


def children(node) -> list:
    """The nodes below a node in reading order, without those of ``_LEAVES``."""
    names = _INNER.get(type(node))
    if names is None:
        names = _INNER[type(node)] = tuple(f for f in node._fields if f not in _LEAVES)
    out = []
    for name in names:
        value = getattr(node, name, None)
        if type(value) is list:
            out += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


def walk(node) -> Iterator:
    """A node and all below it, breadth first."""
    todo = [node]
    for one in todo:
        todo += children(one)
        yield one


def dotted(node, *through) -> str:
    """``a.b.c`` of a name chain; empty for anything else. ``through`` lists node types to look through."""
    parts = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif through and isinstance(node, through):
            node = node.func if isinstance(node, ast.Call) else node.value
        else:
            break
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def last(name: str) -> str:
    return name.rpartition(".")[2]


def keyword(call: ast.Call, name: str):
    return next((k.value for k in call.keywords if k.arg == name), None)


def constant(node, kind):
    """The constant of a node if it has the type, else None."""
    good = isinstance(node, ast.Constant) and isinstance(node.value, kind)
    return node.value if good else None


def string_of(node):
    """A plain string, also when written as an f-string without fields."""
    if isinstance(node, ast.JoinedStr):
        pieces = [constant(v, str) for v in node.values]
        return None if None in pieces else "".join(pieces)
    return constant(node, str)


def shown(node):
    return None if node is None else ast.unparse(node)


def flag(node):
    value = constant(node, bool)
    return None if value is None else str(value)


def strings_in(node) -> list[str]:
    if isinstance(node, _LISTS):
        return [s for item in node.elts for s in strings_in(item)]
    value = constant(node, str)
    return [] if value is None else [value]


def value_of(node):
    """A small description of an expression that column predicates can test."""
    if node is None:
        return None
    literal = isinstance(node, ast.Constant)
    entries = []
    if isinstance(node, ast.Dict):
        for key, item in zip(node.keys, node.values):
            if constant(key, str) is not None and isinstance(item, ast.Constant):
                entries.append({"key": key.value, "literal": str(item.value) if not isinstance(item.value, str) else "'" + item.value})
    return {
        "node": type(node).__name__,
        "type": type(node.value).__name__ if literal else None,
        "literal": str(node.value) if literal and not isinstance(node.value, (str, bytes)) else None,
        "dotted": dotted(node),
        "callee": dotted(node.func) if isinstance(node, ast.Call) else None,
        "operator": type(node.op).__name__ if isinstance(node, ast.BinOp) else None,
        "strings": strings_in(node),
        "entries": entries,
    }


def dependency_of(node) -> dict:
    """A dependency expression: its text, what it declares and the names a security scheme can hide in."""
    text = ast.unparse(node)
    row = {"expression": text, "form": "expression", "name": text, "candidates": [], "scopes": [], "use_cache": None}
    if not isinstance(node, ast.Call):
        return row
    declared = last(dotted(node.func, ast.Subscript, ast.Call))
    target = node
    row["form"] = "call"
    if declared in markers.DEPENDENCY_CALLS:
        target = node.args[0] if node.args else keyword(node, "dependency")
        scopes = keyword(node, "scopes")
        listed = scopes.elts if isinstance(scopes, _LISTS) else []
        row.update(
            form=declared,
            name=shown(target),
            scopes=list(dict.fromkeys(s for s in (constant(e, str) for e in listed) if s)),
            use_cache=flag(keyword(node, "use_cache")),
        )
    if target is not None:
        named = (n.func if isinstance(n, ast.Call) else n for n in walk(target) if isinstance(n, (ast.Name, ast.Attribute, ast.Call)))
        found = [dotted(n, ast.Subscript, ast.Call) for n in named]
        row["candidates"] = [c for c in (*found, row["name"]) if c]
    return row


def dependencies_in(call: ast.Call, name: str = "dependencies") -> list[dict]:
    value = keyword(call, name)
    if value is None:
        return []
    return [dependency_of(n) for n in (value.elts if isinstance(value, _LISTS) else [value])]


def annotation_parts(node):
    """The annotated type and the metadata that follows it inside ``Annotated``."""
    if isinstance(node, ast.Subscript) and last(dotted(node.value, ast.Subscript)) == "Annotated":
        inner = list(node.slice.elts) if isinstance(node.slice, ast.Tuple) else [node.slice]
        if inner:
            return inner[0], inner[1:]
    return node, []


def nullable(node) -> bool:
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return nullable(node.left) or nullable(node.right)
    if isinstance(node, ast.Constant):
        return node.value is None
    if isinstance(node, ast.Name):
        return node.id in ("None", "NoneType")
    if isinstance(node, ast.Subscript):
        name = last(dotted(node.value, ast.Subscript))
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        return name == "Optional" or (name == "Union" and any(nullable(n) for n in inner))
    return False


def arguments_of(node) -> list[tuple]:
    """(argument, slot, default) in signature order."""
    args = node.args
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    rows = [(a, "positional", d) for a, d in zip(plain, defaults)]
    rows += [(args.vararg, "vararg", None)] if args.vararg else []
    rows += [(a, "keyword", d) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    return rows + ([(args.kwarg, "kwargs", None)] if args.kwarg else [])


class Source:
    """Text of a file with its lines, for cutting out the segment of a node without rescanning the file."""

    def __init__(self, content: str):
        self.raw = content.encode("utf-8", "surrogatepass")
        self.starts = [m.start() for m in _LINE.finditer(self.raw)]

    def segment(self, node) -> str:
        begin = self.starts[node.lineno - 1] + node.col_offset
        end = self.starts[node.end_lineno - 1] + node.end_col_offset
        return " ".join(self.raw[begin:end].decode("utf-8", "replace").split())

    def evidence(self, node) -> str:
        return self.segment(node)


def place_of(node) -> dict:
    return {
        "line_start": node.lineno,
        "line_end": node.end_lineno,
        "column_start": node.col_offset + 1,
        "column_end": node.end_col_offset + 1,
    }


def parameter_of(arg, slot, default, source: Source) -> dict:
    base, metadata = annotation_parts(arg.annotation)
    calls = [n for n in (default, *metadata) if isinstance(n, ast.Call)]
    marker = next((c for c in calls if last(dotted(c.func, ast.Subscript)) in markers.PARAMETER_CALLS), None)
    first = marker.args[0] if marker is not None and marker.args else None
    examples = [keyword(marker, n) for n in ("example", "examples", "openapi_examples")] if marker is not None else []
    names = {last(dotted(n, ast.Subscript)) for n in walk(base)} if base is not None else set()
    return {
        "name": arg.arg,
        "slot": slot,
        "annotation": shown(arg.annotation if slot in ("vararg", "kwargs") else base),
        "annotation_names": sorted(n for n in names if n),
        "annotation_nullable": base is not None and nullable(base),
        "annotation_source": source.evidence(arg.annotation) if arg.annotation is not None else "",
        "default": shown(default),
        "has_default": default is not None,
        "default_none": isinstance(default, ast.Constant) and default.value is None,
        "marker": last(dotted(marker.func, ast.Subscript)) if marker is not None else None,
        "marker_args": first is not None,
        "marker_first": shown(first),
        "marker_first_type": type(first.value).__name__ if isinstance(first, ast.Constant) else None,
        "description": constant(keyword(marker, "description"), str) if marker is not None else None,
        "alias": constant(keyword(marker, "alias"), str) if marker is not None else None,
        "example": shown(next((e for e in examples if e is not None), None)),
        "deprecated": flag(keyword(marker, "deprecated")) if marker is not None else None,
    }


def dependency_calls(nodes, source: Source) -> list[dict]:
    """Calls of ``...Depends`` and ``...Security`` below the nodes, as written and as normalised."""
    calls = [n for node in nodes for n in walk(node) if isinstance(n, ast.Call)]
    return [
        {"text": source.segment(c), "expression": ast.unparse(c)}
        for c in calls
        if dotted(c.func).endswith(markers.DEPENDENCY_CALLS)
    ]


def route_of(decorator, routers: dict, source: Source):
    """A route decorator, or None for any other decorator."""
    if not isinstance(decorator, ast.Call):
        return None
    verb = last(dotted(decorator.func)).lower()
    if verb not in markers.ROUTE_VERBS:
        return None
    attribute = isinstance(decorator.func, ast.Attribute)
    variable = dotted(decorator.func.value, ast.Subscript) if attribute else ""
    first = decorator.args[0] if decorator.args else None
    listed = keyword(decorator, "tags")
    declared = keyword(decorator, "responses")
    responses = []
    for key, item in zip(declared.keys, declared.values) if isinstance(declared, ast.Dict) else ():
        if constant(key, int) is not None:
            fields = {constant(k, str): v for k, v in zip(item.keys, item.values)} if isinstance(item, ast.Dict) else {}
            responses.append({
                "status": int(key.value),
                "model": shown(fields.get("model")),
                "description": constant(fields.get("description"), str),
            })
    code = constant(keyword(decorator, "status_code"), int)
    inside = [k.value for k in decorator.keywords if k.arg == "dependencies"]
    return {
        "verb": verb,
        "attribute": attribute,
        "has_args": first is not None,
        "path_literal": constant(first, str),
        "path_text": string_of(first),
        "path_keyword": string_of(keyword(decorator, "path")),
        "router_variable": variable,
        "router": routers.get(variable),
        "tags": [s for s in map(string_of, listed.elts) if s is not None] if isinstance(listed, _LISTS) else [],
        "summary": string_of(keyword(decorator, "summary")),
        "description": string_of(keyword(decorator, "description")),
        "deprecated": flag(keyword(decorator, "deprecated")),
        "response_model": shown(keyword(decorator, "response_model")),
        "status_code": None if code is None or isinstance(code, bool) else code,
        "response_class": shown(keyword(decorator, "response_class")),
        "operation_id": string_of(keyword(decorator, "operation_id")),
        "dependencies": dependencies_in(decorator),
        "dependency_calls": dependency_calls(inside, source),
        "responses": responses,
        "place": place_of(decorator),
        "evidence": source.evidence(decorator),
    }


def reads_in(node) -> list[dict]:
    """Attribute and key reads below a node, as (root object, field)."""
    rows = []
    for n in walk(node):
        if isinstance(n, ast.Attribute):
            field = n.attr
        elif isinstance(n, ast.Subscript):
            field = constant(n.slice, str)
        else:
            continue
        root = n.value
        while isinstance(root, (ast.Attribute, ast.Subscript)):
            root = root.value
        if field and isinstance(root, ast.Name):
            rows.append({"root": root.id.lower(), "field": field.lower()})
    return rows


def compared_name(node) -> str:
    """Dotted text of a compared expression; a text key in brackets counts as a field of a named object."""
    chain = []
    while isinstance(node, (ast.Attribute, ast.Subscript)):
        chain.append(node)
        node = node.value
    name = node.id if isinstance(node, ast.Name) else ""
    for link in reversed(chain):
        part = link.attr if isinstance(link, ast.Attribute) else constant(link.slice, str)
        if part and (name or isinstance(link, ast.Attribute)):
            name = f"{name}.{part}" if name else part
    return name.lower()


def exit_of(node):
    value = node.value if isinstance(node, ast.Return) else node.exc
    if not isinstance(value, ast.Call):
        return None
    status = keyword(value, "status_code")
    number = constant(status, int)
    return {
        "form": "return" if isinstance(node, ast.Return) else "raise",
        "callee": dotted(value.func),
        "status": None if number is None else int(number),
        "status_ref": ast.unparse(status) if isinstance(status, ast.Attribute) else None,
        "detail": constant(keyword(value, "detail"), str),
    }


def function_of(node, routes, inside_route: bool, source: Source) -> dict:
    """Everything the rules ask about a decorated function, in breadth-first order of its tree."""
    handlers = {n.name for n in walk(node) if isinstance(n, ast.ExceptHandler) and n.name}
    row = {"calls": [], "compares": [], "tests": [], "handler_uses": [], "exits": [], "assigns": False}
    for n in walk(node):
        if isinstance(n, ast.Call):
            first = n.args[0] if n.args else None
            links = [k.value for k in n.keywords if k.arg in ("url", "location")]
            spread = [k.value for k in n.keywords if k.arg is None and isinstance(k.value, ast.Call)]
            values = [*n.args, *(k.value for k in n.keywords)]
            row["calls"].append({
                "name": dotted(n.func),
                "first_name": getattr(first, "id", None),
                "linked": bool(links),
                "link_name": getattr(links[-1], "id", None) if links else None,
                "arg_names": sorted({m.id for v in values for m in walk(v) if isinstance(m, ast.Name)}),
                "unpacked": [dotted(s.func) for s in spread if isinstance(s.func, ast.Attribute) and isinstance(s.func.value, ast.Name)],
                "place": place_of(n),
                "evidence": source.evidence(n),
            })
        elif isinstance(n, ast.Compare):
            row["compares"].append(sorted({t for t in map(compared_name, (n.left, *n.comparators)) if t}))
        elif isinstance(n, (ast.If, ast.IfExp, ast.Assert)):
            reads = reads_in(n.test)
            if reads:
                row["tests"].append({"reads": reads, "place": place_of(n.test), "evidence": source.evidence(n.test)})
        elif isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            row["assigns"] = True
        elif isinstance(n, (ast.Return, ast.Raise)):
            leaving = exit_of(n)
            row["exits"] += [leaving] if leaving else []
        text_call = isinstance(n, ast.Call) and dotted(n.func) == "str" and n.args
        used = n.args[0] if text_call else n
        if handlers and isinstance(used, ast.Name) and used.id in handlers:
            row["handler_uses"].append({"place": place_of(n), "evidence": source.evidence(n)})
    parameters = arguments_of(node)
    found = []
    for arg, slot, default in parameters:
        if slot in ("positional", "keyword"):
            for holder in (default, *annotation_parts(arg.annotation)[1]):
                calls = [c for c in walk(holder) if isinstance(c, ast.Call)] if holder is not None else []
                found += [dependency_of(c) for c in calls if last(dotted(c.func, ast.Subscript, ast.Call)) in markers.DEPENDENCY_CALLS]
    row.update(
        name=node.name,
        line=node.lineno,
        text=source.segment(node),
        docstring=ast.get_docstring(node, clean=True),
        inside_route=inside_route,
        routes=routes,
        parameters=[parameter_of(a, s, d, source) for a, s, d in parameters],
        dependencies=found,
        dependency_calls=dependency_calls([node.args], source),
    )
    return row


def routers_of(tree) -> list[tuple]:
    """Router definitions of a module, in breadth-first order; a later one replaces an earlier one of its name."""
    rows = []
    for node in walk(tree):
        if not isinstance(node, (ast.Assign, ast.AnnAssign)) or not isinstance(node.value, ast.Call):
            continue
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        if len(targets) != 1 or not isinstance(targets[0], ast.Name) or last(dotted(node.value.func, ast.Subscript)) != "APIRouter":
            continue
        tags = keyword(node.value, "tags")
        rows.append((node, {
            "variable": targets[0].id,
            "prefix": string_of(keyword(node.value, "prefix")) or "",
            "tags": [s for s in map(string_of, tags.elts) if s is not None] if isinstance(tags, _LISTS) else [],
            "dependencies": dependencies_in(node.value),
        }))
    return rows


def target_names(node) -> list[str]:
    if isinstance(node, (ast.Tuple, ast.List)):
        return [n for item in node.elts for n in target_names(item)]
    name = getattr(node, "id", None) or getattr(node, "attr", None)
    return [name] if isinstance(node, (ast.Name, ast.Attribute)) and name else []


def target_field(node) -> str:
    if isinstance(node, ast.Subscript):
        return (constant(node.slice, str) or "").lower()
    return (target_names(node) or [""])[0].lower() if isinstance(node, (ast.Name, ast.Attribute)) else ""


def assignment_of(node):
    targets = node.targets if isinstance(node, ast.Assign) else [node.target]
    root = node.value.value if isinstance(node.value, ast.Subscript) else node.value
    while isinstance(root, ast.Attribute):
        root = root.value
    return {
        "names": [n for t in targets for n in target_names(t)],
        "fields": [target_field(t) for t in targets],
        "root": root.id.lower() if isinstance(root, ast.Name) else "",
        "text": constant(node.value, str),
        "value": value_of(node.value),
    }


def facts_of(content: str) -> Iterator[dict]:
    """Facts of one parsed file, in reading order. Scope is carried down an explicit stack."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(content)
    source = Source(content)
    definitions = routers_of(tree)
    routers = {row["variable"]: {k: v for k, v in row.items() if k != "variable"} for _, row in definitions}
    for node, row in definitions:
        yield {"kind": "router", "place": place_of(node), "evidence": source.evidence(node), "router": row}
    # (node, function, class, inside a signature, inside a route function)
    stack = [(tree, None, None, False, False)]
    while stack:
        node, function, owner, signature, inside = stack.pop()
        common = {"function_name": function, "class_name": owner, "in_signature": signature}
        if isinstance(node, ast.Call):
            args = [value_of(a) for a in node.args]
            yield {
                **common, "kind": "call", "place": place_of(node), "evidence": source.evidence(node),
                "call": {
                    "callee": dotted(node.func),
                    "arg0": args[0] if args else None,
                    "arg1": args[1] if len(args) > 1 else None,
                    "args": args,
                    "keywords": [{"name": k.arg, "value": value_of(k.value)} for k in node.keywords],
                },
            }
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
            yield {**common, "kind": "assign", "place": place_of(node), "evidence": source.evidence(node), "assign": assignment_of(node)}
        signature_parts = ()
        if isinstance(node, _DEFS):
            routes = [r for r in (route_of(d, routers, source) for d in node.decorator_list) if r]
            if routes:
                yield {
                    "kind": "function", "function_name": node.name, "class_name": owner, "place": place_of(node),
                    "evidence": source.evidence(node), "function": function_of(node, routes, inside, source),
                }
            function = node.name
            inside = inside or any(r["verb"] in markers.RULE_VERBS for r in routes)
            signature_parts = {id(n) for n in (*node.decorator_list, node.args, node.returns, *getattr(node, "type_params", ())) if n}
        elif isinstance(node, ast.ClassDef):
            owner = node.name
        below = [(n, function, owner, signature or id(n) in signature_parts, inside) for n in children(node)]
        stack.extend(reversed(below))


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(SCHEMA))


def rows_of(project, path: str, content: str, kinds: tuple[str, ...] | None = None) -> Iterator[dict]:
    """Facts of a file and a closing row that counts it as read; of a file that cannot be read to its end only that row, with the error.

    With ``kinds``, only rows of these; their numbers are those that they have among all.
    """
    known = {"project_id": project, "relative_path": path}
    error, found = None, []
    try:
        found = list(facts_of(content))
    except SyntaxError as problem:
        error = f"{path}:{problem.lineno or 0}: SyntaxError: {problem.msg or 'invalid syntax'}"
    except (RecursionError, MemoryError, ValueError) as problem:
        error = f"{path}:0: {type(problem).__name__}: {problem}"
    for count, fact in enumerate(found, 1):
        if kinds is None or fact["kind"] in kinds:
            yield {**known, "seq": count, **fact}
    if kinds is None or "file" in kinds:
        yield {**known, "seq": len(found) + 1, "kind": "file", "error": error}


def code_facts(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of the Python files of ``files(project_id, relative_path, language, content)``, or those of some ``kinds`` if no others are wanted.

    Each file is parsed once. Files keep the partitioning they come in; batches are bounded by bytes
    (``spark.sql.execution.arrow.maxBytesPerBatch``) and the output by rows, so large files do not pile up.
    A file that cannot be parsed yields an error row and never stops the job.
    """
    schema = _arrow_schema()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            projects, paths, contents = batch.columns
            for project, path, content in zip(projects, paths, contents):
                for row in rows_of(project.as_py(), path.as_py(), content.as_py() or "", kinds):
                    rows.append(row)
                    held += len(row["function"]["text"]) if row["kind"] == "function" else 0
                    if len(rows) >= _ROWS_PER_BATCH or held >= _TEXT_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    python = files.filter(F.lower("language") == "python").select(F.col("project_id").cast("string"), "relative_path", "content")
    return python.mapInArrow(parse, SCHEMA)


def parse_errors(facts: DataFrame) -> DataFrame:
    """One row per file that could not be analysed."""
    return facts.filter("kind = 'file' and error is not null").select("project_id", "relative_path", "error")
