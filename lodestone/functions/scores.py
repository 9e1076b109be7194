"""Score formulas of edges, symbols, paths, dependencies and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strength of each kind of data flow.
FLOW_STRENGTH = {
    "assignment": 0.9,
    "parameter_passing": 0.8,
    "return_value": 0.8,
    "property_access": 0.7,
    "array_access": 0.7,
    "destructuring": 0.8,
    "spread": 0.6,
    "closure_capture": 0.7,
    "callback_parameter": 0.6,
    "promise_resolution": 0.5,
    "conditional_flow": 0.4,
}
#: Weight of each kind of edge, symbol, scope and path.
EDGE_WEIGHT = {"calls": 1.0, "data_flow": 0.9, "imports": 0.8, "throws": 0.9, "catches": 0.9, "extends": 0.7, "implements": 0.7, "exports": 0.6, "instantiates": 0.8, "accesses": 0.6, "assigns": 0.7, "configures": 0.5, "depends_on": 0.6}
SYMBOL_WEIGHT = {"function": 0.3, "method": 0.3, "class": 0.2, "variable": 0.1, "property": 0.1, "module": 0.2}
SCOPE_WEIGHT = {"local": 0.1, "class": 0.08, "module": 0.05, "global": 0.02}
PATH_WEIGHT = {"call_chain": 1.0, "data_flow_chain": 0.95, "error_propagation": 0.9, "dependency_chain": 0.8, "inheritance_chain": 0.7, "mixed": 0.6}


def weight(kind: Column, table: dict[str, float], default: float) -> Column:
    """The entry of a table of fixed values, or ``default``."""
    entries = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(entries, kind), F.lit(default))


def flow_strength(kind: Column) -> Column:
    return weight(kind, FLOW_STRENGTH, 0.5)


def _unit(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def _has(query: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(query), F.lit(w))
    return found


def semantic_boost(kind: Column, query: Column) -> Column:
    """By words of the query: errors favour throws and catches, tracing calls, data the flow of data."""
    errors = _has(query, "error", "exception") & kind.isin("throws", "catches")
    traces = _has(query, "debug", "trace") & (kind == "calls")
    flows = _has(query, "data", "variable") & (kind == "data_flow")
    return F.when(errors, 0.3).when(traces, 0.2).when(flows, 0.25).otherwise(0.0)


def error_factor(kind: Column, errors: Column) -> Column:
    handled = 1 + F.least(F.lit(0.5), errors * 0.1)
    other = F.greatest(F.lit(0.7), 1 - errors * 0.05)
    return F.when(F.coalesce(errors, F.lit(0)) <= 0, 1.0).when(kind.isin("throws", "catches"), handled).otherwise(other)


def edge_score(kind: Column, strength: Column, confidence: Column, frequency: Column, days: Column, errors: Column, feedback: Column, query: Column) -> Column:
    """Strength x weight of the kind x confidence x boosts, in 0..1; days, errors and feedback may be null."""
    recent = F.when(days.isNull(), 1.0).otherwise(1 + recency(days))
    liked = 1 + F.coalesce(feedback, F.lit(0.0)) * 0.2
    raw = strength * weight(kind, EDGE_WEIGHT, 0.5) * confidence * frequency_boost(F.coalesce(frequency, F.lit(1)))
    return _unit(raw * recent * error_factor(kind, errors) * liked * (1 + semantic_boost(kind, query)))


def symbol_score(kind: Column, scope: Column, name: Column, days: Column, errors: Column, focused: Column, feedback: Column) -> Column:
    """.5 + weights of kind and scope + recency, error handling, focus and feedback, in 0..1."""
    handles = _has(name, "error", "catch", "handle") & (F.coalesce(errors, F.lit(0)) > 0)
    raw = F.lit(0.5) + weight(kind, SYMBOL_WEIGHT, 0.1) + weight(scope, SCOPE_WEIGHT, 0.05) + F.coalesce(recency(days), F.lit(0.0))
    raw = raw + F.when(handles, F.least(F.lit(0.3), errors * 0.05)).otherwise(0.0) + F.when(focused, 0.2).otherwise(0.0)
    return _unit(raw + F.coalesce(feedback, F.lit(0.0)) * 0.3)


def path_relevance(description: Column, names: Column, query: Column) -> Column:
    """.5 if the description holds the query, .3 x the share of query words (over two letters) among the names; at most .5."""
    low = F.lower(query)
    terms = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 2)
    share = F.try_divide(F.size(F.filter(terms, lambda w: F.contains(F.lower(names), w))), F.size(terms))
    return F.least(F.lit(0.5), F.when(F.contains(F.lower(description), low), 0.5).otherwise(0.0) + F.coalesce(share, F.lit(0.0)) * 0.3)


def path_score(kind: Column, strength: Column, depth: Column, description: Column, names: Column, query: Column) -> Column:
    """Strength x weight of the kind x .8 for every further edge x 1.3 if the query asks for the kind x .7 beyond four edges x relevance."""
    wanted = (_has(query, "error") & (kind == "error_propagation")) | (_has(query, "data") & (kind == "data_flow_chain")) | (_has(query, "call") & (kind == "call_chain"))
    raw = strength * weight(kind, PATH_WEIGHT, 0.5) * F.pow(F.lit(0.8), depth - 1)
    raw = raw * F.when(wanted, 1.3).otherwise(1.0) * F.when(depth > 4, 0.7).otherwise(1.0)
    return _unit(raw * (1 + path_relevance(description, names, query) * 0.3))


def multi_hop_score(score: Column, kind: Column, strength: Column, depth: Column, crosses_files: Column) -> Column:
    """A path's score x its efficiency from two edges on x 1.4, 1.3 or 1.2 by kind x .9 for every edge over five x 1.2 if it ends in another file."""
    efficiency = strength / F.sqrt(depth)
    chain = F.when(kind == "error_propagation", 1.4).when(kind == "data_flow_chain", 1.3).when((kind == "call_chain") & depth.between(2, 4), 1.2).otherwise(1.0)
    far = F.when(depth > 5, F.pow(F.lit(0.9), depth - 5)).otherwise(1.0)
    return F.when(depth >= 2, score * efficiency * chain).otherwise(score) * far * F.when((depth >= 2) & crosses_files, 1.2).otherwise(1.0)


def keyword_relevance(strength: Column, confidence: Column, words: Column, query: Column) -> Column:
    """Strength x confidence x (1 + .5 x share of query words, over two letters, in the edge's text)."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 2)
    share = F.try_divide(F.size(F.filter(terms, lambda w: F.contains(F.lower(words), w))), F.size(terms))
    return strength * confidence * (1 + F.coalesce(share, F.lit(0.0)) * 0.5)


def overall_relevance(symbols: Column, edges: Column, paths: Column) -> Column:
    """.3 / .4 / .3 of the mean scores, 0 for what is missing."""
    return F.coalesce(symbols, F.lit(0.0)) * 0.3 + F.coalesce(edges, F.lit(0.0)) * 0.4 + F.coalesce(paths, F.lit(0.0)) * 0.3


def chunk_overlap(same_file: Column, same_type: Column, a: Column, b: Column) -> Column:
    """.8 in one file, .6 of one type, else the overlap of the token arrays."""
    return F.when(same_file, 0.8).when(same_type, 0.6).otherwise(jaccard(a, b))


def semantic_similarity(cosine: Column, overlap: Column) -> Column:
    return cosine * 0.7 + overlap * 0.3


def recency(days: Column) -> Column:
    return F.exp(-days / 7) * 0.3


def frequency_boost(n: Column) -> Column:
    return F.least(F.lit(2.0), 1 + F.log10(F.greatest(n, F.lit(1))) * 0.3)


def call_strength(is_identifier: Column, has_arguments: Column) -> Column:
    return F.least(F.lit(1.0), 0.7 + F.when(is_identifier, 0.2).otherwise(0.0) + F.when(has_arguments, 0.1).otherwise(0.0))


def dependency_strength(usage: Column, is_default: Column, type_only: Column) -> Column:
    by_use = F.when(usage > 10, 0.3).when(usage > 5, 0.2).when(usage > 1, 0.1).otherwise(0.0)
    raw = 0.5 + by_use + F.when(is_default, 0.1).otherwise(0.0) - F.when(type_only, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), raw))


def completeness(critical: Column, forward: Column, backward: Column, context: Column) -> Column:
    """.4 / .3 / .2 / .1 by non-empty class."""
    return sum((F.when(n > 0, w).otherwise(0.0) for n, w in ((critical, 0.4), (forward, 0.3), (backward, 0.2), (context, 0.1))), F.lit(0.0))


def group_importance(mean_complexity: Column, recent: Column) -> Column:
    return F.least(F.lit(1.0), mean_complexity / 10 + F.when(recent, 0.2).otherwise(0.0))


def path_strength(strengths: Column) -> Column:
    """Right fold of pairwise means: (s1 + (s2 + ...) / 2) / 2."""
    n = F.size(strengths)
    return F.aggregate(F.reverse(F.slice(strengths, 1, n - 1)), F.element_at(strengths, -1), lambda acc, s: (s + acc) / 2)


#: The chain that edges of one kind make, its theme, and the verb of an edge.
CHAIN = {"calls": "call_chain", "imports": "dependency_chain", "depends_on": "dependency_chain", "data_flow": "data_flow_chain", "throws": "error_propagation", "catches": "error_propagation", "extends": "inheritance_chain", "implements": "inheritance_chain"}
THEME = {"call_chain": "Function Calls", "dependency_chain": "Module Dependencies", "data_flow_chain": "Data Flow", "error_propagation": "Error Handling", "configuration_chain": "Configuration", "inheritance_chain": "Class Inheritance", "mixed": "Related Code"}
VERB = {"calls": "calls", "imports": "imports", "exports": "exports", "extends": "extends", "implements": "implements", "instantiates": "creates", "accesses": "accesses", "assigns": "assigns to", "throws": "throws", "catches": "catches", "configures": "configures", "depends_on": "depends on", "data_flow": "flows to"}


def _word(key: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def path_type(types: Column) -> Column:
    """The chain of a path whose edges are all of one kind, else mixed."""
    one = F.size(F.array_distinct(types)) == 1
    return F.when(one, _word(F.element_at(types, 1), CHAIN, "mixed")).otherwise("mixed")


def theme(kind: Column) -> Column:
    return _word(kind, THEME, "Related Code")


def path_description(names: Column, types: Column) -> Column:
    """Verb for one edge, arrows for a chain of one kind, else first, last and the number of hops."""
    arrow = F.array_join(names, " → ")
    kind, n = path_type(types), F.size(names)
    hops = F.concat(F.element_at(names, 1), F.lit(" → ... → "), F.element_at(names, -1), F.lit(" ("), (n - 1).cast("string"), F.lit(" hops)"))
    many = F.when(kind == "call_chain", F.concat(F.lit("Call chain: "), arrow)).when(kind == "dependency_chain", F.concat(F.lit("Dependency: "), arrow))
    many = many.when(kind == "data_flow_chain", F.concat(F.lit("Data flows: "), arrow)).when(kind == "error_propagation", F.concat(F.lit("Error propagation: "), arrow)).otherwise(hops)
    one = F.concat_ws(" ", F.element_at(names, 1), _word(F.element_at(types, 1), VERB, "relates to"), F.element_at(names, 2))
    return F.when(n < 2, "").when(n == 2, one).otherwise(many)


def debounce_ms(activity: Column, priority: Column, base: int = 500) -> Column:
    """x3 / x1.5 / x.8 by activity, x.5 critical, x2 low priority, within 100 to 10000."""
    a = F.when(activity == "high", 3.0).when(activity == "medium", 1.5).when(activity == "low", 0.8).otherwise(1.0)
    p = F.when(priority == "critical", 0.5).when(priority == "low", 2.0).otherwise(1.0)
    return F.greatest(F.lit(100.0), F.least(F.lit(10000.0), a * p * base))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays, 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def extraction_confidence(files: Column, functions: Column, symbols: Column) -> Column:
    n = files + functions + symbols
    raw = F.least(F.lit(0.9), 0.3 + n * 0.15) + F.when(files > 0, 0.2).otherwise(0.0) + F.when(functions > 0, 0.1).otherwise(0.0)
    return F.when(n == 0, 0.1).otherwise(F.least(F.lit(0.95), raw))
