"""The source rules as column predicates over code facts, evaluated in one pass.

A rule names the facts it looks at (calls, assignments or routes) and gives a predicate. All rules of a fact
are evaluated while the fact streams by: the hits of a row are an array that is exploded once. Nothing is
shuffled until repeats are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from palisade.catalog import markers as m, rules as catalog
from palisade.functions import text
from palisade.operators.ranking import first_per

HIT = "struct<rule_id:string, place:struct<line_start:int,line_end:int,column_start:int,column_end:int>, evidence:string, detail:map<string,string>>"


@dataclass(frozen=True)
class Rule:
    """``hit`` maps a fact to a hit column that is null when the rule does not apply."""

    rule_id: str
    fact: str
    hit: Callable[..., Column]


RULES: dict[str, Rule] = {}


def register_rule(rule: Rule, replace: bool = False) -> None:
    """Add a rule. An id can be registered once unless ``replace`` is set."""
    key = rule.rule_id.strip().upper()
    if key in RULES and not replace:
        raise ValueError(f"rule registered twice: {key}")
    RULES[key] = rule


def _struct(rule_id: str, place: Column, evidence: Column, **detail) -> Column:
    pairs = []
    for name, value in detail.items():
        value = value() if callable(value) and not isinstance(value, Column) else value
        pairs += [F.lit(name), value if isinstance(value, Column) else F.lit(str(value))]
    details = F.create_map(*pairs) if pairs else F.create_map()
    return F.struct(
        F.lit(rule_id).alias("rule_id"), place.alias("place"), evidence.alias("evidence"),
        details.cast("map<string,string>").alias("detail"),
    )


# --- Reading a call fact ---


def callee() -> Column:
    return F.col("call.callee")


def keywords() -> Column:
    return F.col("call.keywords")


def at_place() -> Column:
    return F.col("place")


def at_text() -> Column:
    return F.col("evidence")


def kw(name: str) -> Column:
    """Value of the first keyword of that name, null when absent."""
    return F.try_element_at(F.filter(keywords(), lambda k: k["name"] == name), F.lit(1))["value"]


def has_kw(name: str) -> Column:
    return F.exists(keywords(), lambda k: k["name"] == name)


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def is_bool(value: Column, wanted: str) -> Column:
    return _yes((value["type"] == "bool") & (value["literal"] == wanted))


def entry_of(value: Column, key: str, only_bool: bool = False) -> Column:
    """Literal of a dictionary key: the first boolean one, or the last one of any type."""
    found = F.filter(value["entries"], lambda e: (e["key"] == key) & (e["literal"].isin("True", "False") if only_bool else F.lit(True)))
    return F.try_element_at(found, F.lit(1 if only_bool else -1))["literal"]


def ends_with_any(name: Column, suffixes) -> Column:
    test = F.lit(False)
    for suffix in suffixes:
        test = test | name.endswith(suffix)
    return test


def leaf(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _call_rule(rule_id: str, test: Callable[[], Column], **detail) -> None:
    register_rule(Rule(rule_id, "call", lambda: F.when(_yes(test()), _struct(rule_id, at_place(), at_text(), **detail))))


def _shell() -> Column:
    value = kw("shell")
    truthy = F.when(value["node"] == "Constant", is_bool(value, "True")).when(
        value["node"] == "Name", F.lower(value["dotted"]) == "true").otherwise(value.isNotNull())
    return callee().isin(*m.SUBPROCESS_CALLS) & truthy


def _sql() -> Column:
    arg = F.col("call.arg0")
    dynamic = (
        (arg["node"] == "JoinedStr")
        | _yes(arg["operator"].isin("Add", "Mod"))
        | _yes((arg["callee"] == "format") | arg["callee"].endswith(".format"))
    )
    return leaf(callee()).isin(*m.SQL_METHODS) & arg.isNotNull() & dynamic


def _ssrf() -> Column:
    positional = F.when(callee().endswith(".request") & F.col("call.arg1").isNotNull(), F.col("call.arg1")).otherwise(F.col("call.arg0"))
    url = F.when(has_kw("url"), kw("url")).otherwise(positional)
    return callee().isin(*m.HTTP_CALLS) & url.isNotNull() & ~_yes(url["type"] == "str")


def _yaml() -> Column:
    return (callee() == "yaml.load") & ~_yes(kw("Loader")["dotted"].endswith("SafeLoader"))


def _is_config_jwt() -> Column:
    return callee().endswith("jwt.decode")


def _cors(credentials: bool) -> Column:
    named = (
        callee().endswith("CORSMiddleware")
        | (callee().endswith(".add_middleware") & _yes(F.col("call.arg0.dotted").endswith("CORSMiddleware")))
        | _yes(kw("middleware_class")["dotted"].endswith("CORSMiddleware"))
    )
    wide = named & _yes(F.array_contains(kw("allow_origins")["strings"], "*"))
    allowed = is_bool(kw("allow_credentials"), "True")
    return wide & (allowed if credentials else ~allowed)


def is_token_decode() -> Column:
    """A JWT decode call as the authentication rules see it: in a body, by name or by its keywords."""
    lowered = F.lower(callee())
    by_keyword = F.exists(keywords(), lambda k: k["name"].isin(*m.JWT_KEYWORDS))
    named = (lowered == "decode") | lowered.endswith(".decode")
    return ~F.coalesce("in_signature", F.lit(False)) & named & (lowered.contains("jwt") | _yes(by_keyword))


_call_rule("CODE-001", lambda: callee() == "eval")
_call_rule("CODE-002", lambda: callee() == "exec")
_call_rule("CMD-001", _shell)
_call_rule("CMD-002", lambda: callee() == "os.system")
_call_rule("DESER-001", lambda: callee().isin(*m.PICKLE_CALLS))
_call_rule("DESER-002", _yaml)
_call_rule("SQL-001", _sql)
_call_rule("SSRF-001", _ssrf)
_call_rule("HTTP-001", lambda: callee().isin(*m.HTTP_CALLS) & ~has_kw("timeout"))
_call_rule("HTTP-002", lambda: callee().isin(*m.HTTP_CALLS) & is_bool(kw("verify"), "False"))
_call_rule("CONFIG-001", lambda: is_bool(kw("debug"), "True") & (callee().endswith(".run") | callee().isin(*m.DEBUG_CALLS)), call=callee)
_call_rule("TLS-001", lambda: (callee().isin(*m.HTTP_CALLS) | ends_with_any(callee(), m.TLS_METHOD_SUFFIXES)) & is_bool(kw("verify"), "False"), call=callee)
_call_rule("JWT-001", lambda: _is_config_jwt() & F.exists(kw("algorithms")["strings"], lambda a: F.lower(a) == "none"))
_call_rule("JWT-002", lambda: _is_config_jwt() & (_yes(entry_of(kw("options"), "verify_signature") == "False") | is_bool(kw("verify"), "False")))
_call_rule("CORS-001", lambda: _cors(False))
_call_rule("CORS-002", lambda: _cors(True))
_call_rule("FASTAPI-AUTH-004", lambda: is_token_decode() & ~has_kw("audience") & ~_yes(entry_of(kw("options"), "verify_aud", True) == "False"), jwt_check="audience")
_call_rule("FASTAPI-AUTH-005", lambda: is_token_decode() & ~has_kw("issuer") & ~_yes(entry_of(kw("options"), "verify_iss", True) == "False"), jwt_check="issuer")
_call_rule("FASTAPI-AUTH-006", lambda: is_token_decode() & _yes(entry_of(kw("options"), "verify_signature", True) == "False"), jwt_check="signature")


# --- Assignments ---


def sensitive_target() -> Column:
    return F.try_element_at(F.filter("assign.names", text.is_sensitive_name), F.lit(1))


def secret_value() -> Column:
    return text.strip(F.col("assign.text"))


def _secret(rule_id: str) -> Column:
    placeholder = text.is_placeholder_secret(secret_value())
    hard_coded = ~placeholder & text.is_probable_secret(secret_value())
    # A value is called weak only where it also passes for a hard-coded secret, or is a placeholder.
    weak = placeholder | (hard_coded & text.is_weak_secret(secret_value()))
    test = sensitive_target().isNotNull() & F.col("assign.text").isNotNull() & (hard_coded if rule_id == "SECRET-001" else weak)
    if rule_id == "SECRET-001":
        more = {"secret_length": F.char_length(secret_value()).cast("string")}
    else:
        more = {"reason": F.when(placeholder, "placeholder-value").otherwise("low-entropy")}
    return F.when(_yes(test), _struct(rule_id, at_place(), text.redact(at_text()), variable_name=sensitive_target(), **more))


def _privilege() -> Column:
    value = F.col("assign.value")
    field = F.try_element_at(F.filter("assign.fields", lambda f: f.isin(*m.ASSIGNED_PRIVILEGES)), F.lit(1))
    from_object = value["node"].isin("Attribute", "Subscript") & F.col("assign.root").isin(*m.ASSIGNING_OBJECTS)
    from_call = _yes(text.contains_any(F.lower(value["callee"]), m.ASSIGNING_CALL_WORDS))
    return F.when(
        _yes(field.isNotNull() & (from_object | from_call)),
        _struct("FASTAPI-AUTH-010", at_place(), at_text(), privileged_field=field),
    )


for _id in ("SECRET-001", "SECRET-002"):
    register_rule(Rule(_id, "assign", lambda _id=_id: _secret(_id)))
register_rule(Rule("FASTAPI-AUTH-010", "assign", _privilege))


# --- Routes. ``r`` is a route of the function in the row; function-level tests are columns named ``_fn_*``. ---

def _path(r: Column) -> Column:
    return F.when(~r["has_args"], "/").otherwise(F.coalesce(r["path_literal"], F.lit("<dynamic>")))


def _subject(r: Column) -> Column:
    return F.lower(F.concat_ws(" ", _path(r), F.col("function.name")))


def _declares(r: Column, words, form: str) -> Column:
    """Whether a dependency of the function or of the route mentions one of the words."""
    calls = F.concat(F.col("function.dependency_calls"), r["dependency_calls"])
    return F.exists(calls, lambda c: text.contains_any(F.lower(c[form]), words))


def _route_struct(rule_id: str, r: Column, place: Column | None = None, evidence: Column | None = None, **more: Column) -> Column:
    return _struct(
        rule_id,
        r["place"] if place is None else place,
        r["evidence"] if evidence is None else evidence,
        endpoint_method=F.upper(r["verb"]), endpoint_path=_path(r), **more,
    )


def _route_rule(
    rule_id: str, test: Callable[[Column], Column], place: Callable[[], Column] | None = None, evidence: Callable[[], Column] | None = None,
    more: Callable[[Column], dict[str, Column]] | None = None,
) -> None:
    def hit(r: Column) -> Column:
        found = _route_struct(rule_id, r, place() if place else None, evidence() if evidence else None, **(more(r) if more else {}))
        return F.when(_yes(r["verb"].isin(*m.RULE_VERBS) & test(r)), found)

    register_rule(Rule(rule_id, "route", hit))


FUNCTION_TESTS: dict[str, Callable[[], Column]] = {
    "_fn_text": lambda: F.lower("function.text"),
    "_fn_names": lambda: F.transform(
        F.filter("function.parameters", lambda p: p["slot"].isin("positional", "keyword")), lambda p: p["name"]),
    "_fn_upload": lambda: F.exists(
        F.filter("function.parameters", lambda p: p["slot"].isin("positional", "keyword")),
        lambda p: F.lower(p["annotation_source"]).contains("uploadfile")
        | (F.lower(p["annotation_source"]) == "bytes")
        | F.lower(p["name"]).isin(*m.UPLOAD_PARAMETER_NAMES)),
    "_fn_authorizes": lambda: F.exists("function.calls", lambda c: leaf(F.lower(c["name"])).isin(*m.AUTHORIZATION_HELPERS)),
    "_fn_owner": lambda: F.exists(
        "function.compares",
        lambda names: F.exists(names, lambda n: leaf(n).isin(*m.OWNERSHIP_FIELDS)) & F.exists(names, lambda n: text.contains_any(n, m.PRINCIPAL_WORDS))),
    "_fn_mutates": lambda: F.col("function.assigns") | F.exists("function.calls", lambda c: leaf(F.lower(c["name"])).isin(*m.MUTATION_METHODS)),
    "_fn_used": lambda: F.flatten(F.transform(
        F.filter("function.calls", lambda c: leaf(F.lower(c["name"])).isin(*m.OBJECT_ACCESS_METHODS)), lambda c: c["arg_names"])),
    "_fn_leak": lambda: F.try_element_at("function.handler_uses", F.lit(1)),
}
CALL_PICKS: dict[str, Callable[[], Column]] = {
    "_fn_redirect": lambda: F.try_element_at(F.filter(
        "function.calls",
        lambda c: c["name"].endswith("RedirectResponse")
        & F.array_contains(F.col("_fn_names"), F.when(c["linked"], c["link_name"]).otherwise(c["first_name"]))), F.lit(1)),
    "_fn_unpack": lambda: F.try_element_at(F.filter(
        "function.calls",
        lambda c: F.exists(c["unpacked"], lambda u: leaf(u).isin(*m.UNPACKED_METHODS) & F.array_contains(F.col("_fn_names"), F.substring_index(u, ".", 1)))), F.lit(1)),
}


def _collection(r: Column) -> Column:
    tail = F.lower(F.substring_index(F.rtrim(_path(r), F.lit("/")), "/", -1))
    return tail.isin(*m.COLLECTION_PATHS) | text.starts_with_any(F.lower(F.col("function.name")), m.COLLECTION_NAME_PREFIXES)


def _controlled(r: Column) -> Column:
    return text.contains_any(F.col("_fn_text"), m.ABUSE_CONTROL_WORDS) | _declares(r, m.ABUSE_CONTROL_WORDS, "text")


def _identifiers(r: Column) -> dict[str, Column]:
    """The path parameters that the function uses to read an object."""
    used = F.array_intersect(text.path_parameters(_path(r)), F.col("_fn_used"))
    return {"object_identifiers": F.array_join(F.array_sort(used), ",")}


def is_object_route(r: Column) -> Column:
    """The route reads an object by an identifier of its path and nothing visible guards it."""
    used = F.arrays_overlap(text.path_parameters(_path(r)), F.col("_fn_used"))
    guarded = (
        F.col("_fn_authorizes")
        | F.col("_fn_owner")
        | F.exists("function.dependency_calls", lambda c: text.contains_any(F.lower(c["expression"]), m.ADMIN_DEPENDENCY_WORDS))
        | F.exists(
            F.flatten(F.transform(F.filter("function.routes", lambda o: o["verb"].isin(*m.RULE_VERBS)), lambda o: o["dependency_calls"])),
            lambda c: text.contains_any(F.lower(c["expression"]), m.ADMIN_DEPENDENCY_WORDS))
    )
    return ~F.col("function.inside_route") & _yes(used) & ~guarded


_route_rule("FASTAPI-AUTH-001", lambda r: ~_declares(r, m.AUTH_DEPENDENCY_WORDS, "text") & (r["verb"] != "delete") & text.contains_any(_subject(r), m.SENSITIVE_PATH_WORDS))
_route_rule("FASTAPI-AUTH-002", lambda r: ~_declares(r, m.AUTH_DEPENDENCY_WORDS, "text") & (r["verb"] == "delete"))
_route_rule("FASTAPI-FILE-001", lambda r: F.col("_fn_upload") & ~text.contains_any(F.col("_fn_text"), m.FILE_VALIDATION_WORDS), at_place, at_text)
_route_rule("FASTAPI-ERROR-001", lambda r: F.col("_fn_leak").isNotNull(), lambda: F.col("_fn_leak.place"), lambda: F.col("_fn_leak.evidence"))
_route_rule("FASTAPI-REDIRECT-001", lambda r: F.col("_fn_redirect").isNotNull(), lambda: F.col("_fn_redirect.place"), lambda: F.col("_fn_redirect.evidence"))
_route_rule("FASTAPI-PROPERTY-001", lambda r: F.col("_fn_unpack").isNotNull(), lambda: F.col("_fn_unpack.place"), lambda: F.col("_fn_unpack.evidence"))
_route_rule("FASTAPI-RESOURCE-001", lambda r: (r["verb"] == "get") & _collection(r) & ~text.contains_any(F.col("_fn_text"), m.PAGINATION_WORDS))
_route_rule("FASTAPI-FLOW-001", lambda r: text.contains_any(_subject(r), m.SENSITIVE_FLOW_WORDS) & ~_controlled(r))
_route_rule("FASTAPI-INVENTORY-001", lambda r: r["deprecated"] == "True")
_route_rule("FASTAPI-AUTH-007", lambda r: text.contains_any(_subject(r), m.ADMIN_WORDS) & ~_declares(r, m.ADMIN_AUTH_WORDS, "expression"))
_route_rule("FASTAPI-AUTH-003", lambda r: (r["verb"] == "get") & is_object_route(r), more=_identifiers)
_route_rule("FASTAPI-AUTH-009", lambda r: F.upper(r["verb"]).isin(*m.MUTATING_VERBS) & is_object_route(r) & F.col("_fn_mutates"), more=_identifiers)


def _decision_hits() -> Column:
    """Tests of a route function that decide on a privilege taken from the request: one hit per test."""

    def read_of(t: Column) -> Column:
        return F.try_element_at(F.filter(t["reads"], lambda x: x["root"].isin(*m.DECIDING_OBJECTS) & x["field"].isin(*m.DECIDING_PRIVILEGES)), F.lit(1))

    visible = ~F.col("function.inside_route") & F.exists("function.routes", lambda r: r["verb"].isin(*m.RULE_VERBS))
    chosen = F.filter("function.tests", lambda t: visible & read_of(t).isNotNull())
    return F.transform(chosen, lambda t: _struct("FASTAPI-AUTH-008", t["place"], t["evidence"], privileged_field=read_of(t)["field"]).cast(HIT))


register_rule(Rule("FASTAPI-AUTH-008", "function", _decision_hits))


_BUILT: dict[tuple, tuple[dict[str, Column], dict[str, Column], Column]] = {}


def _built(application: str) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """The column expressions of all registered rules. They do not depend on the data, so one build per
    application and rule set is enough."""
    key = (application, tuple(id(r) for r in RULES.values()))
    if key not in _BUILT:
        by_fact: dict[str, list[Rule]] = {}
        for rule in RULES.values():
            by_fact.setdefault(rule.fact, []).append(rule)

        def hits(kind: str) -> Column:
            return F.array_compact(F.array(*[r.hit().cast(HIT) for r in by_fact[kind]]))

        route_hits = F.flatten(F.transform(
            "function.routes", lambda r: F.array_compact(F.array(*[rule.hit(r).cast(HIT) for rule in by_fact["route"]]))))
        function_hits = F.concat(route_hits, *[rule.hit() for rule in by_fact.get("function", ())])
        found = F.when(F.col("kind") == "call", hits("call")).when(F.col("kind") == "assign", hits("assign")).otherwise(function_hits)
        tests = {name: build() for name, build in FUNCTION_TESTS.items()}
        _BUILT[key] = (tests, {name: build() for name, build in CALL_PICKS.items()}, found)
    return _BUILT[key]


def raw_hits(facts: DataFrame) -> DataFrame:
    """All hits of all rules, repeats included; ``hit_no`` counts the hits of a fact in the order of its decorators and rules."""
    tests, picks, found = _built(facts.sparkSession.sparkContext.applicationId)
    prepared = facts.filter(F.col("kind").isin("call", "assign", "function")).withColumns(tests).withColumns(picks)
    # The outer form keeps the optimizer from adding a size test that would evaluate every rule twice.
    return prepared.select(
        "project_id", "relative_path", "seq", "function_name", "class_name", F.posexplode_outer(found).alias("hit_no", "hit"),
    ).filter("hit is not null").select(
        "project_id", "relative_path", "seq", "function_name", "class_name", "hit_no", "hit.rule_id", "hit.place.*", "hit.evidence", "hit.detail",
    )


def source_findings(facts: DataFrame) -> DataFrame:
    """Source findings with their rule texts. The first hit of a rule on a line stays; later ones are repeats."""
    spark = facts.sparkSession
    hits = raw_hits(facts)
    line = F.coalesce("line_start", F.lit(0))
    kept = first_per(hits, ["project_id", "relative_path", "rule_id", line], [F.asc("seq"), F.asc("column_start"), F.asc("hit_no")]).drop("hit_no")
    analyzers = catalog.analyzers(spark).select("analyzer", "analyzer_ord")
    texts = catalog.source_rules(spark).join(F.broadcast(analyzers), "analyzer")
    joined = kept.join(F.broadcast(texts), "rule_id")
    return joined.withColumns({
        "file_path": F.col("relative_path"),
        "fingerprint": F.concat_ws("|", "rule_id", "relative_path", line.cast("string"), F.lit(""), F.lit("")),
        "seq": F.struct("analyzer_ord", "relative_path", "seq"),
        "status": F.lit("open"),
        "language": F.lit("python"),
    })
