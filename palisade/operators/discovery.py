"""API discovery: endpoints, parameters, dependencies and responses out of function facts.

All of it is column work on the function fact; the only row change is one row per route. A route carries the
definition of its router, so nothing has to be joined.
"""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column, DataFrame, functions as F

from palisade.catalog import markers as m
from palisade.functions import paths, text

# The kinds of facts that endpoints come from.
ENDPOINT_FACTS = ("function",)
RESPONSE = "struct<status_code:int, model:string, description:string>"


def distinct(*arrays: Column) -> Column:
    """Ordered distinct union of arrays without empty values."""
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]), lambda v: v != ""))


def _names(words, value: Column) -> Column:
    return F.coalesce(text.contains_any(F.lower(value), words), F.lit(False))


def scheme_of(dependency: Column) -> Column:
    """Security scheme of a dependency: the first of its names that a rule recognises."""

    def scheme(name: Column) -> Column:
        final = F.substring_index(name, ".", -1)
        chain = F.when(final.isin(*m.SECURITY_CONSTRUCTORS), final)
        for words, label in m.SCHEME_WORDS:
            chain = chain.when(text.contains_any(F.lower(name), words), F.lit(label))
        return chain

    return F.try_element_at(F.filter(F.transform(dependency["candidates"], scheme), lambda s: s.isNotNull()), F.lit(1))


def requires_auth(dependency: Column) -> Column:
    declared = dependency["form"].isin(*m.DEPENDENCY_CALLS)
    return (
        (dependency["form"] == "Security")
        | (declared & scheme_of(dependency).isNotNull())
        | _names(m.DISCOVERY_AUTH_WORDS, dependency["name"])
    )


def requires_permission(dependency: Column) -> Column:
    return (F.size(dependency["scopes"]) > 0) | _names(m.DISCOVERY_PERMISSION_WORDS, dependency["name"])


def _symbolic_status(reference: Column) -> Column:
    """Status code of ``status.HTTP_404_NOT_FOUND`` or ``HTTPStatus.NOT_FOUND``. The first form is spelled after
    the phrase of the code, so phrases with punctuation or a different constant name do not resolve."""
    by_phrase = {f"HTTP_{s.value}_{s.phrase.upper().replace(' ', '_')}": s.value for s in HTTPStatus}
    by_name = {name: s.value for name, s in HTTPStatus.__members__.items()}

    def lookup(table: dict[str, int]) -> Column:
        pairs = F.create_map(*[part for name, code in table.items() for part in (F.lit(name), F.lit(code))])
        return F.try_element_at(pairs, F.substring_index(reference, ".", -1))

    return F.when(reference.startswith("status."), lookup(by_phrase)).when(reference.startswith("HTTPStatus."), lookup(by_name))


def body_responses(exits: Column) -> Column:
    """Responses a body shows: returned response objects and raised HTTP errors."""

    def response(x: Column) -> Column:
        code = F.coalesce(x["status"], _symbolic_status(x["status_ref"]))
        returned = (x["form"] == "return") & x["callee"].endswith("Response")
        model = F.when(x["callee"].endswith("JSONResponse"), "JSONResponse").otherwise("Response")
        raised = (x["form"] == "raise") & x["callee"].endswith("HTTPException") & code.isNotNull()
        nothing = F.lit(None).cast("string")
        return (
            F.when(returned, F.struct(F.coalesce(code, F.lit(200)).alias("status_code"), model.alias("model"), nothing.alias("description")).cast(RESPONSE))
            .when(raised, F.struct(code.alias("status_code"), nothing.alias("model"), x["detail"].alias("description")).cast(RESPONSE)))

    return F.array_compact(F.transform(exits, response))


def _parameter(p: Column, route_path: Column) -> Column:
    """Location, default and nullability of a parameter from what its signature shows."""
    fixed = p["slot"].isin("vararg", "kwargs")
    in_path = F.exists(F.split(route_path, "/"), lambda s: s.startswith(F.concat(F.lit("{"), p["name"])) & s.endswith("}"))
    marked = F.try_element_at(F.create_map(*[F.lit(x) for pair in m.PARAMETER_CALLS.items() for x in pair]), p["marker"])
    location = (
        F.when(fixed, p["slot"])
        .when(p["marker"].isNotNull(), marked)
        .when(F.array_contains(p["annotation_names"], "UploadFile"), "file")
        .when(in_path, "path")
        .otherwise(F.when(p["slot"] == "keyword", "keyword").otherwise("unknown"))
    )
    open_ended = p["marker_first_type"] == "ellipsis"
    required = (
        F.when(fixed, F.lit(False))
        .when(location == "path", F.lit(True))
        .when(p["marker_args"], F.coalesce(open_ended, F.lit(False)))
        .otherwise(~p["has_default"])
    )
    default = F.when(p["marker_args"], F.when(F.coalesce(open_ended, F.lit(False)), F.lit(None)).otherwise(p["marker_first"])).otherwise(p["default"])
    null_marker = F.coalesce(p["marker_first_type"] == "NoneType", F.lit(False))
    return F.struct(
        p["name"].alias("name"),
        location.alias("location"),
        p["annotation"].alias("python_type"),
        required.alias("required"),
        default.alias("default_value"),
        p["description"].alias("description"),
        p["alias"].alias("alias"),
        p["example"].alias("example"),
        (F.coalesce(p["deprecated"], F.lit("False")) == "True").alias("deprecated"),
        (~fixed & (p["annotation_nullable"] | p["default_none"] | null_marker)).alias("nullable"),
    )


def endpoints(facts: DataFrame) -> DataFrame:
    """One row per route decorator on a method name, with parameters, dependencies, flags and responses."""
    f = "function"
    routes = facts.filter("kind = 'function'").select(
        "project_id", "relative_path", "seq", "class_name", f, F.posexplode("function.routes").alias("route_no", "r"),
    ).filter(F.col("r.attribute") & F.col("r.verb").isin(*m.ROUTE_VERBS))
    path = F.when(F.col("r.has_args"), F.coalesce("r.path_text", F.lit("/"))).otherwise(F.coalesce("r.path_keyword", F.lit("/")))
    prefix = F.coalesce("r.router.prefix", F.lit(""))
    expression = lambda d: d["expression"]
    router_deps = F.coalesce("r.router.dependencies", F.filter("r.dependencies", lambda d: F.lit(False)))
    stored = F.concat(router_deps, F.col("r.dependencies"))
    every = F.concat(stored, F.col("function.dependencies"))
    declared = F.transform("r.responses", lambda x: F.struct(x["status"].alias("status_code"), x["model"].alias("model"), x["description"].alias("description")).cast(RESPONSE))
    coarse = F.exists(F.transform(stored, expression), lambda e: _names(m.COARSE_AUTH_WORDS, e))
    prepared = routes.withColumns({"path": path, "_all": every})
    return prepared.select(
        "project_id", "relative_path", "seq", "route_no", "class_name",
        F.upper("r.verb").alias("method"),
        "path",
        prefix.alias("router_prefix"),
        paths.join_paths(prefix, F.col("path")).alias("full_path"),
        F.col("r.router_variable").alias("router_variable"),
        F.col("function.name").alias("function_name"),
        F.col("function.line").alias("line_number"),
        distinct(F.coalesce("r.router.tags", F.array().cast("array<string>")), F.col("r.tags")).alias("tags"),
        F.col("r.summary").alias("summary"),
        F.coalesce(F.nullif("r.description", F.lit("")), F.col("function.docstring")).alias("description"),
        (F.coalesce("r.deprecated", F.lit("False")) == "True").alias("deprecated"),
        F.col("r.response_model").alias("response_model"),
        F.col("r.status_code").alias("status_code"),
        F.col("r.response_class").alias("response_class"),
        F.col("r.operation_id").alias("operation_id"),
        distinct(F.transform("_all", expression)).alias("dependencies"),
        distinct(F.transform("_all", lambda d: F.coalesce(scheme_of(d), F.lit("")))).alias("security_schemes"),
        distinct(F.flatten(F.transform("_all", lambda d: d["scopes"]))).alias("security_scopes"),
        (coarse | F.exists("_all", requires_auth)).alias("authentication_required"),
        F.exists("_all", requires_permission).alias("permission_required"),
        F.transform("function.parameters", lambda p: _parameter(p, F.col("path"))).alias("_parameters"),
        F.array_distinct(F.concat(declared, body_responses(F.col("function.exits")))).alias("responses"),
    ).withColumn(
        # Receivers are not parameters.
        "parameters", F.filter("_parameters", lambda p: ~(p["name"].isin("self", "cls") & ~p["location"].isin("vararg", "kwargs", "keyword"))),
    ).drop("_parameters")


def dependency_rows(facts: DataFrame) -> DataFrame:
    """Dependencies of functions as rows: what each declares and which flags it raises."""
    listed = facts.filter("kind = 'function'").select(
        "project_id", "relative_path", F.col("function.name").alias("function_name"), F.explode("function.dependencies").alias("d"))
    return listed.select(
        "project_id", "relative_path", "function_name", "d.expression", F.col("d.name").alias("dependency_name"),
        F.col("d.form").alias("declaration_type"), scheme_of(F.col("d")).alias("security_scheme"), "d.scopes", "d.use_cache",
        requires_auth(F.col("d")).alias("authentication_required"), requires_permission(F.col("d")).alias("permission_required"),
    ).distinct()


def routers(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'router'").select(
        "project_id", "relative_path", F.col("place.line_start").alias("line_number"), "router.variable", "router.prefix", "router.tags",
        F.transform("router.dependencies", lambda d: d["expression"]).alias("dependencies"))


def stored_endpoints(endpoints: DataFrame) -> DataFrame:
    """The form endpoints are stored in: known methods and locations, an authentication type, one status code."""
    method = F.upper("method")
    return endpoints.select(
        "project_id",
        F.when(method.isin(*m.STORED_METHODS), method).otherwise("ANY").alias("http_method"),
        F.col("full_path").alias("path"),
        F.nullif("router_prefix", F.lit("")).alias("router_prefix"),
        "operation_id", "function_name",
        F.col("relative_path").alias("source_file"),
        "line_number", "authentication_required",
        F.when(F.col("authentication_required"), "unknown").otherwise("public").alias("authentication_type"),
        "tags", "dependencies", "response_model",
        F.col("status_code").alias("response_status_code"),
        "summary", "description", "deprecated", "permission_required", "security_schemes", "security_scopes",
        F.transform("parameters", _stored_parameter).alias("parameters"),
        # The stored table holds one response per status; the first one found stays.
        F.filter("responses", lambda x, i: ~F.exists(F.slice(F.col("responses"), F.lit(1), i), lambda y: y["status_code"] == x["status_code"])).alias("responses"),
    )


def _stored_parameter(p: Column) -> Column:
    place = F.upper(p["location"])
    return F.struct(
        p["name"].alias("name"), F.when(place.isin(*m.STORED_LOCATIONS), place).otherwise("UNKNOWN").alias("location"),
        p["python_type"].alias("data_type"), p["required"].alias("required"), p["default_value"].alias("default_value"),
        p["description"].alias("description"), p["example"].alias("example_value"))
