"""Rules over a symbol's columns: role, risk, confidence, assessment and what to verify."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TYPE_KINDS

#: Fixed values.
TEST_PATH_TERMS = ("/tests/", "/test/", "__tests__", "/fixtures/", "/mocks/", ".spec.", ".test.", "_test.")
HIGH_RISK_TERMS = (
    "handler", "handlers", "route", "routes", "router", "registry", "register", "command", "commands", "event", "events", "listener", "subscriber", "plugin", "plugins", "hook", "hooks", "store", "stores", "pinia", "dispatch",
    "emitter", "bus",
)
MEDIUM_RISK_TERMS = ("factory", "provider", "adapter", "bridge", "service", "worker")
HANDLER_PREFIXES = ("handle_", "on_", "register_", "emit_", "listen_", "dispatch_")


def _name() -> Column:
    return F.col("name")


def _path() -> Column:
    return F.col("file_path")


def _qualified() -> Column:
    return F.col("qualified_name")


def any_of(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms), F.lit(False))


def is_local() -> Column:
    return F.col("source") == "local"


def is_exported() -> Column:
    return F.col("visibility").isin("public", "protected")


def is_test_symbol() -> Column:
    return any_of(F.lower(F.concat_ws(" ", _path(), _qualified())), TEST_PATH_TERMS) | _name().startswith("test_") | _name().endswith("_test")


def is_probably_test_file(path: Column | None = None) -> Column:
    path = _path() if path is None else path
    return any_of(path, ("/tests/", "test/", "_test.")) | path.endswith(".spec.ts") | path.endswith(".test.ts")


def symbol_role() -> Column:
    return (
        F.when(~is_local(), "external_dependency").when(is_test_symbol(), "test_only").when(F.col("kind").isin(*TYPE_KINDS) & is_exported(), "public_type_or_module")
        .when(is_exported(), "public_api").otherwise("internal_implementation")
    )


def _fingerprint() -> Column:
    return F.lower(F.concat_ws(" ", _path(), _name(), _qualified()))


def looks_like_handler() -> Column:
    return reduce(lambda a, b: a | b, (_name().startswith(p) for p in HANDLER_PREFIXES))


def looks_like_store() -> Column:
    return _name().startswith("use") & _name().endswith("Store")


def dynamic_risk() -> Column:
    high = any_of(_fingerprint(), HIGH_RISK_TERMS) | looks_like_handler() | looks_like_store()
    medium = is_exported() | any_of(_fingerprint(), MEDIUM_RISK_TERMS)
    return F.when(~is_local() | is_test_symbol(), "low").when(high, "high").when(medium, "medium").otherwise("low")


def risk_factors() -> Column:
    """Why a symbol may be used in ways that no edge shows, as short sentences."""
    found = F.array_compact(F.array(
        F.when(any_of(_fingerprint(), HIGH_RISK_TERMS), "named like wiring, such as routes, events or stores"), F.when(looks_like_handler(), "prefixed like a callback"),
        F.when(looks_like_store(), "named like a store's hook"), F.when(symbol_role() == "public_api", "open to other packages"), F.when(any_of(_fingerprint(), MEDIUM_RISK_TERMS), "named like a service or adapter"),
    ))
    quiet = F.when((F.size(found) == 0) & ~is_exported(), F.array(F.lit("nothing hints at dynamic use"))).otherwise(found)
    return F.when(~is_local(), F.array(F.lit("defined outside the project"))).when(is_test_symbol(), F.array(F.lit("part of the tests"))).otherwise(quiet)


def confidence(incoming: Column | None = None, outgoing: Column | None = None) -> Column:
    role, risk = symbol_role(), dynamic_risk()
    score = F.lit(0.58)
    if incoming is not None:
        score = score + F.when(incoming == 0, 0.04).otherwise(0.12)
    if outgoing is not None:
        score = score + F.when(outgoing > 0, 0.02).otherwise(0.0)
    score = score - F.when(is_local(), 0.0).otherwise(0.14) + F.when(is_exported(), -0.06).otherwise(0.06)
    score = score + F.when(role == "internal_implementation", 0.08).when(role == "test_only", 0.12).when(role == "public_api", -0.08).when(role == "public_type_or_module", -0.04).otherwise(-0.12)
    score = score - F.when(risk == "high", 0.24).when(risk == "medium", 0.12).otherwise(0.0)
    return F.greatest(F.lit(0.15), F.least(F.lit(0.92), score))


def assessment(incoming: Column) -> Column:
    return F.when(~is_local(), "reference_only").when(incoming > 0, "statically_referenced").when(dynamic_risk().isin("high", "medium"), "dynamic_entry_candidate").otherwise("unused_candidate")


def assessment_note(kind: Column) -> Column:
    """What an assessment means to whoever plans a change."""
    return (
        F.when(kind == "statically_referenced", "Edges lead here: look at the callers and at the reach of a change.")
        .when(kind == "dynamic_entry_candidate", "No edge leads here, but names suggest wiring at run time: search the text and the registrations.")
        .when(kind == "unused_candidate", "No edge leads here: perhaps unused, which a search has to confirm.")
        .otherwise("Known by its uses alone: what it does is decided elsewhere.")
    )


def verification_hints(incoming: Column, outgoing: Column) -> Column:
    """What to check before and after a change, the most urgent first."""
    return F.array_compact(F.array(
        F.when(incoming == 0, "Search the text for the name, as no edge leads here.").otherwise("Read the callers."), F.when(dynamic_risk().isin("high", "medium"), "Search routes, registrations and events for the name."),
        F.when(looks_like_store(), "Ask how the framework finds its stores."), F.when(is_exported(), "Search other packages that may import it."), F.when(symbol_role() == "test_only", "Search fixtures and test harnesses."),
        F.when(outgoing > 0, "Read the callees that a change passes on to."), F.lit("Build, and run the tests nearby."),
    ))


def search_terms() -> Column:
    parts = F.transform(F.split("signature", r"[(),:]"), lambda x: F.trim(x))
    first = F.element_at(F.filter(parts, lambda x: ~x.isin("", "fn", "&self")), 1)
    first = F.when(F.size(F.filter(parts, lambda x: ~x.isin("", "fn", "&self"))) > 0, first)
    bare = F.when(_name().startswith("handle_"), F.regexp_replace(_name(), "^(handle_)+", ""))
    return F.array_distinct(F.array_compact(F.array(_name(), _qualified(), first, bare)))


def verification_plan(has_neighbours: Column) -> Column:
    """The names of the steps that verify a symbol, in order."""
    return F.transform(verification_steps(has_neighbours), lambda x: x["step"])


def verification_steps(has_neighbours: Column) -> Column:
    """array<struct<step, reason, queries>>: each step with why it is taken and what it searches for."""
    step = lambda name, reason, queries: F.struct(F.lit(name).alias("step"), reason.alias("reason"), queries.alias("queries"))
    none = F.array().cast("array<string>")
    return F.array_compact(F.array(
        step("search_text_references", F.lit("names in strings and templates leave no edge"), search_terms()), F.when(dynamic_risk().isin("high", "medium"), step("inspect_dynamic_wiring", F.array_join(risk_factors(), "; "), F.array(_name()))),
        F.when(has_neighbours, step("read_structural_neighbors", F.lit("callers and callees share its contract"), F.array(_qualified()))), step("compile_and_test", F.lit("a build finds what edges can't"), none),
    ))


def impact_risk(callers: Column, callees: Column, files: Column) -> Column:
    return F.when((callers > 10) | (callees > 15) | (files > 8), "high").when((callers <= 3) & (callees <= 5) & (files <= 3), "low").otherwise("medium")


def impact_reasons(callers: Column, callees: Column, files: Column) -> Column:
    """What makes an impact more than low, each count with the bound that it passes."""
    over = lambda name, count, low, high: F.when(count > high, f"{name} > {high}").when(count > low, f"{name} > {low}")
    found = F.array_compact(F.array(over("callers", callers, 3, 10), over("callees", callees, 5, 15), over("files", files, 3, 8)))
    return F.when(F.size(found) == 0, F.array(F.lit("few neighbours"))).otherwise(found)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4).cast("long")


def group_key(path: Column | None = None) -> Column:
    path = _path() if path is None else path
    return F.split(path, "/")[0]


def rust_module_path(path: Column | None = None) -> Column:
    """``src/a/b.rs`` and ``src/a/b/mod.rs`` are crate::a::b; the roots are crate."""
    path = _path() if path is None else path
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^(.*/)?src/", ""), r"\.rs$", ""), "(^|/)(mod|lib|main)$", "")
    return F.when(inner == "", "crate").otherwise(F.concat(F.lit("crate::"), F.replace(inner, F.lit("/"), F.lit("::"))))


def rust_absolute(target: Column, module: Column) -> Column:
    """A path that begins with crate, self or super, seen from ``module``; any other path as it is."""
    up = F.when(module.contains("::"), F.regexp_replace(module, "::[^:]+$", "")).otherwise(module)
    return F.when(target.startswith("self::"), F.concat(module, F.substring(target, 5, 1 << 30))).when(target.startswith("super::"), F.concat(up, F.substring(target, 6, 1 << 30))).otherwise(target)
