"""The typed predicate language: JSON trees checked against a symbol table and compiled to Spark columns.

A compiled expression is a pair of columns (value, error): errors such as a missing binding, overflow or division by zero are a third result, never false.
Every integer expression carries bounds of its value. While they fit, it is a native DECIMAL(38,0); beyond, and for bit operations, it is the 64 hex digits of
evalloom.functions.uint256, so results are those of 256 bits at any size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions import uint256
from evalloom.functions.canonical import sha256_hex

# Fixed values of the language.
FIELDS = {
    "symbol": {"symbol_id", "state"}, "bound": {"variable", "type"}, "literal": {"type", "value"}, "unary": {"operator", "operand"}, "binary": {"operator", "left", "right"},
    "quantifier": {"operator", "variable", "variable_type", "domain", "body"}, "temporal": {"operator", "operand", "horizon"},
}
TYPES = {"bool", "uint256", "int256", "address", "bytes32"}
INTEGERS = {"uint256", "int256"}
LOGIC, EQUALITY, ORDER = {"and", "or", "implies"}, {"eq", "neq"}, {"ge", "le", "gt", "lt"}
ARITHMETIC = {"add", "sub", "mul", "div", "mod"}
BITS, SHIFTS = {"band", "bor", "bxor"}, {"shl", "shr", "sar"}
RANGES = {"uint256": (0, 1 << 256), "int256": (-(1 << 255), 1 << 255)}
WIDEST = 10**38
MAX_NODES = 256


class Refused(ValueError):
    """A diagnostic: where, which and what."""

    def __init__(self, path: str, code: str, message: str):
        super().__init__(f"{path}: {code}: {message}")
        self.path, self.code, self.message = path, code, message


@dataclass
class Compiled:
    value: Column
    error: Column
    kind: str
    window: bool = False
    low: int = 0  # of an integer
    high: int = 0
    wide: bool = False  # hex digits instead of a decimal

    def hex(self) -> Column:
        return self.value if self.wide else uint256.from_decimal(self.value)


@dataclass
class Compiler:
    """symbols: id to (type, domain); columns: (id, state) to the bound column; wide: ids whose columns hold hex digits, those of other integers being decimals."""

    symbols: dict[str, tuple[str, str]]
    columns: dict[tuple[str, str], Column]
    trace: str | None = None
    index: str | None = None
    wide: frozenset[str] = frozenset()
    bound: dict[str, tuple[str, object]] = field(default_factory=dict)
    nodes: int = 0

    def predicate(self, proposal: dict) -> Compiled:
        """An invariant's body; its root must be bool."""
        if proposal.get("abstain") is True:
            raise Refused("$", "abstained", str(proposal.get("reason")))
        if proposal.get("kind") != "invariant":
            raise Refused("$.kind", "invalid_kind", "must be invariant")
        if extra := set(proposal) - {"kind", "invariant_id", "body"}:
            raise Refused("$", "unsupported_fields", ", ".join(sorted(extra)))
        out = self.expression(proposal.get("body"), "$.body")
        if out.kind != "bool":
            raise Refused("$.body", "non_boolean_root", out.kind)
        return out

    def expression(self, raw: object, path: str) -> Compiled:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise Refused(path, "ast_limit", f"more than {MAX_NODES} nodes")
        kind = raw.get("kind") if isinstance(raw, dict) else None
        if kind not in FIELDS:
            raise Refused(path, "invalid_expression_kind", str(kind))
        if extra := set(raw) - FIELDS[kind] - {"kind"}:
            raise Refused(path, "unsupported_fields", ", ".join(sorted(extra)))
        return getattr(self, f"_{kind}")(raw, path)

    def _symbol(self, raw: dict, path: str) -> Compiled:
        name, state = raw.get("symbol_id"), raw.get("state")
        if name not in self.symbols:
            raise Refused(f"{path}.symbol_id", "unresolved_symbol", str(name))
        if state not in ("pre", "post"):
            raise Refused(f"{path}.state", "invalid_state", str(state))
        column, kind = self.columns[name, state], self.symbols[name][0]
        error = F.when(column.isNull(), f"missing binding {name}")
        if kind not in INTEGERS:
            return Compiled(column, error, kind)
        low, high = RANGES[kind]
        if name in self.wide:
            return Compiled(column, error, kind, low=low, high=high - 1, wide=True)
        if kind == "uint256":
            error = F.coalesce(error, F.when(column < 0, f"invalid value of {name}"))
        return Compiled(column, error, kind, low=max(low, 1 - WIDEST), high=WIDEST - 1)

    def _literal(self, raw: dict, path: str) -> Compiled:
        kind, value = raw.get("type"), raw.get("value")
        if kind not in TYPES:
            raise Refused(f"{path}.type", "invalid_literal_type", str(kind))
        if kind == "bool":
            ok = isinstance(value, bool)
        elif kind in INTEGERS:
            ok = isinstance(value, int) and not isinstance(value, bool) and RANGES[kind][0] <= value < RANGES[kind][1]
        else:
            ok = isinstance(value, str) and value.startswith("0x") and len(value) == {"address": 42, "bytes32": 66}[kind] and all(c in "0123456789abcdefABCDEF" for c in value[2:])
        if not ok:
            raise Refused(path, "invalid_literal", f"{value!r} isn't a {kind}")
        none = F.lit(None).cast("string")
        if kind not in INTEGERS:
            return Compiled(F.lit(value), none, kind)
        wide = abs(value) >= WIDEST
        return Compiled(F.lit(uint256.encode(value)) if wide else F.lit(str(value)).cast("decimal(38,0)"), none, kind, low=value, high=value, wide=wide)

    def _bound(self, raw: dict, path: str) -> Compiled:
        name = raw.get("variable")
        if name not in self.bound:
            raise Refused(f"{path}.variable", "unresolved_bound_variable", str(name))
        kind, value = self.bound[name]
        if raw.get("type") != kind:
            raise Refused(f"{path}.type", "type_mismatch", f"{name} is {kind}")
        return self._literal({"type": kind, "value": value}, path)

    def _unary(self, raw: dict, path: str) -> Compiled:
        operator, x = raw.get("operator"), self.expression(raw.get("operand"), f"{path}.operand")
        if operator == "not" and x.kind == "bool":
            return Compiled(~x.value, x.error, "bool", x.window)
        if operator == "neg" and x.kind == "int256":
            return self._arithmetic("sub", self._literal({"type": x.kind, "value": 0}, path), x)
        if operator == "bitnot" and x.kind in INTEGERS:
            return self._arithmetic("bxor", x, self._literal({"type": x.kind, "value": -1 if x.kind == "int256" else RANGES[x.kind][1] - 1}, path))
        raise Refused(path, "type_mismatch", f"{operator} of {x.kind}")

    def _binary(self, raw: dict, path: str) -> Compiled:
        operator = raw.get("operator")
        a, b = self.expression(raw.get("left"), f"{path}.left"), self.expression(raw.get("right"), f"{path}.right")
        if operator in SHIFTS and (a.kind not in INTEGERS or b.kind != "uint256" or operator == "sar" and a.kind != "int256"):
            raise Refused(path, "type_mismatch", f"{a.kind} {operator} {b.kind}")
        if a.kind != b.kind and operator not in SHIFTS:
            raise Refused(path, "type_mismatch", f"{a.kind} {operator} {b.kind}")
        window = a.window or b.window
        if operator in LOGIC:
            if a.kind != "bool":
                raise Refused(path, "type_mismatch", f"{operator} of {a.kind}")
            left = ~a.value if operator == "implies" else a.value
            # the right side, and its error, only count where the left doesn't decide
            decided = left == F.lit(operator != "and")
            value = F.when(a.error.isNotNull(), F.lit(None)).when(decided, F.lit(operator != "and")).otherwise(b.value)
            return Compiled(value.cast("boolean"), F.coalesce(a.error, F.when(~decided, b.error)), "bool", window)
        error = F.coalesce(a.error, b.error)
        if (a.wide or b.wide) and operator in EQUALITY | ORDER:
            key = uint256.signed_key if a.kind == "int256" and operator in ORDER else lambda c: c
            a, b = (Compiled(key(x.hex()), x.error, x.kind, x.window) for x in (a, b))
        if operator in EQUALITY:
            return Compiled(a.value == b.value if operator == "eq" else a.value != b.value, error, "bool", window)
        if a.kind not in INTEGERS:
            raise Refused(path, "type_mismatch", f"{operator} of {a.kind}")
        if operator in ORDER:
            value = {"ge": a.value >= b.value, "le": a.value <= b.value, "gt": a.value > b.value, "lt": a.value < b.value}[operator]
            return Compiled(value, error, "bool", window)
        if operator not in ARITHMETIC | BITS | SHIFTS:
            raise Refused(path, "unsupported_operator", str(operator))
        return self._arithmetic(operator, a, b)

    def _arithmetic(self, operator: str, a: Compiled, b: Compiled) -> Compiled:
        """Native as long as the bounds of operands and result fit into decimals."""
        error, window, (least, limit) = F.coalesce(a.error, b.error), a.window or b.window, RANGES[a.kind]
        if operator in ARITHMETIC:
            size = max(abs(a.low), abs(a.high))
            corners = [x * y for x in (a.low, a.high) for y in (b.low, b.high)]
            low, high = {
                "add": (a.low + b.low, a.high + b.high), "sub": (a.low - b.high, a.high - b.low), "mul": (min(corners), max(corners)),
                "div": (-size if least else 0, size), "mod": (-size if least else 0, size),
            }[operator]
        else:
            low, high = least, limit - 1
        bounds = {"low": max(low, least), "high": min(high, limit - 1)}
        if a.wide or b.wide or operator not in ARITHMETIC or not -WIDEST < low <= high < WIDEST:
            out = uint256.arith(operator, a.value, b.value, signed=bool(least))
            problem = F.coalesce(error, out["error"])
            return Compiled(F.when(problem.isNull(), out["value"]), problem, a.kind, window, wide=True, **bounds)
        x, y = a.value.cast("decimal(38,0)"), b.value.cast("decimal(38,0)")
        zero = y == 0
        whole = {"add": F.try_add(x, y), "sub": F.try_subtract(x, y), "mul": F.try_multiply(x, y), "div": F.when(~zero, F.call_function("div", x, F.when(~zero, y))), "mod": F.try_mod(x, F.when(~zero, y))}[operator].cast("decimal(38,0)")
        problem = F.when(zero, "division by zero" if operator == "div" else "modulo by zero") if operator in ("div", "mod") else F.lit(None).cast("string")
        if not least:
            problem = F.coalesce(problem, F.when(whole < 0, "underflow"))
        problem = F.coalesce(error, problem)
        return Compiled(F.when(problem.isNull(), whole), problem, a.kind, window, **bounds)

    def _quantifier(self, raw: dict, path: str) -> Compiled:
        """Unrolled over its literals; an empty domain is true for forall, false for exists."""
        name, kind = raw.get("variable"), raw.get("variable_type")
        if name in self.bound:
            raise Refused(f"{path}.variable", "shadowed_variable", str(name))
        if raw.get("operator") not in ("forall", "exists"):
            raise Refused(f"{path}.operator", "invalid_quantifier", str(raw.get("operator")))
        every = raw["operator"] == "forall"
        out = Compiled(F.lit(every), F.lit(None).cast("string"), "bool")
        for value in raw.get("domain"):
            self.nodes += 1
            self.bound[name] = kind, value
            x = self.expression(raw.get("body"), f"{path}.body")
            if x.kind != "bool":
                raise Refused(f"{path}.body", "type_mismatch", x.kind)
            open_ = out.value == F.lit(every)
            out = Compiled(F.when(open_, x.value).otherwise(out.value), F.coalesce(out.error, F.when(open_, x.error)), "bool", out.window or x.window)
        self.bound.pop(name, None)
        return out

    def _temporal(self, raw: dict, path: str) -> Compiled:
        """once: at some position of the last `horizon` ones or now; globally: at all positions of the trace, whatever the index."""
        if not self.trace:
            raise Refused(path, "no_trace", "temporal operators need a trace")
        x = self.expression(raw.get("operand"), f"{path}.operand")
        if x.kind != "bool" or x.window:
            raise Refused(path, "type_mismatch", "a temporal operand is a state predicate")
        if raw.get("operator") == "once":
            w = Window.partitionBy(self.trace).orderBy(self.index).rowsBetween(-int(raw["horizon"]), 0)
            value = F.max(x.value.cast("int")).over(w) > 0
        elif raw.get("operator") == "globally":
            w = Window.partitionBy(self.trace)
            value = F.min(x.value.cast("int")).over(w) > 0
        else:
            raise Refused(f"{path}.operator", "invalid_temporal", str(raw.get("operator")))
        return Compiled(value, F.min(x.error).over(w), "bool", True)


# The shorthand predicates: their arity and core form.
PRIMITIVES = {
    "justified_destination_effect": (2, "implies"), "replay_exclusion": (1, "not"), "quorum_authorization": (1, "identity"), "proof_binding": (2, "implies"),
    "callback_noninterference": (1, "not"), "challenge_window": (2, "implies not"), "intent_consumption": (1, "identity"),
}


def expand(raw: object) -> object:
    """Primitive nodes as their core forms, everywhere in a tree."""
    if isinstance(raw, list):
        return [expand(x) for x in raw]
    if not isinstance(raw, dict):
        return raw
    if raw.get("kind") != "primitive":
        return {k: expand(v) for k, v in raw.items()}
    arity, form = PRIMITIVES.get(raw.get("primitive_id"), (-1, ""))
    given = raw.get("arguments")
    if not isinstance(given, list) or len(given) != arity or not all(isinstance(a, dict) for a in given):
        raise Refused("$", "invalid_primitive", str(raw.get("primitive_id")))
    arguments = [expand(a) for a in given]
    if form.endswith("not"):
        arguments[-1] = {"kind": "unary", "operator": "not", "operand": arguments[-1]}
    return {"kind": "binary", "operator": "implies", "left": arguments[0], "right": arguments[1]} if form.startswith("implies") else arguments[0]


def references(raw: object) -> list[tuple[str, str]]:
    """The distinct (symbol, state) references of a tree, in order."""
    if isinstance(raw, list):
        return sorted({r for x in raw for r in references(x)})
    if not isinstance(raw, dict):
        return []
    if raw.get("kind") == "symbol":
        return [(raw["symbol_id"], raw["state"])]
    return sorted({r for x in raw.values() for r in references(x)})


def identity(proposal: dict) -> str:
    """The canonical hash of an invariant's expanded body."""
    return sha256_hex(expand(proposal["body"]))


def evaluate(rows: DataFrame, proposal: dict, compiler: Compiler, key: list[str]) -> DataFrame:
    """(key, holds, error, verdict): PASS, FAIL or UNKNOWN for each row."""
    out = compiler.predicate({**proposal, "body": expand(proposal.get("body"))})
    held = rows.select(*key, F.when(out.error.isNull(), out.value).alias("holds"), out.error.alias("error"))
    return held.select(*key, "holds", "error", F.when(F.col("error").isNotNull() | F.col("holds").isNull(), "UNKNOWN").when(F.col("holds"), "PASS").otherwise("FAIL").alias("verdict"))


def reachability(rows: DataFrame, hit: Column, error: Column, order: str, by: list[str], exhaustive: bool) -> DataFrame:
    """The first satisfying binding, or the first error before it; exhausted without either is unsatisfiable only when the rows are declared exhaustive."""
    t = rows.groupBy(*by).agg(F.min(F.when(error.isNull() & hit, F.col(order))).alias("first_hit"), F.min(F.when(error.isNotNull(), F.col(order))).alias("first_error"))
    blocked = F.col("first_error").isNotNull() & (F.col("first_hit").isNull() | (F.col("first_error") < F.col("first_hit")))
    return t.select(*by, F.when(blocked, "unknown").when(F.col("first_hit").isNotNull(), "reachable").otherwise("bounded_unsat" if exhaustive else "unknown").alias("status"), F.when(~blocked, F.col("first_hit")).alias("witness"))


def independent(rows: DataFrame, proposal: dict, compiler: Compiler, key: list[str], declared_hash: str) -> DataFrame:
    """evaluate(), by an evaluator that first hashes the property itself: another hash than the declared one makes every row UNKNOWN."""
    out = evaluate(rows, proposal, compiler, key)
    if identity(proposal) == declared_hash:
        return out
    return out.select(*key, F.lit(None).cast("boolean").alias("holds"), F.lit("property hash mismatch").alias("error"), F.lit("UNKNOWN").alias("verdict"))


# Solver operators of the core ones; division and modulo have none.
SOLVER = {
    "not": "not", "and": "and", "or": "or", "implies": "=>", "eq": "=", "neq": "distinct", "add": "bvadd", "sub": "bvsub", "mul": "bvmul", "neg": "bvneg", "bitnot": "bvnot",
    "band": "bvand", "bor": "bvor", "bxor": "bvxor", "shl": "bvshl", "shr": "bvlshr", "sar": "bvashr",
}
SIGNED_ORDER = {"ge": ("bvuge", "bvsge"), "le": ("bvule", "bvsle"), "gt": ("bvugt", "bvsgt"), "lt": ("bvult", "bvslt")}


def lower(raw: dict, symbols: dict[str, tuple[str, str]], trace_length: int | None = None, at: int | None = None, bound: dict | None = None, path: str = "$.body") -> tuple[str, dict[str, str]]:
    """(solver-neutral text of an expanded tree, source path of each symbol's name). Quantifiers and temporal operators are unrolled; bit vectors have 256 bits.

    Temporal operators need a trace length; the free position is the last one.
    """
    bound, kind = bound or {}, raw.get("kind")
    names: dict[str, str] = {}

    def child(node: dict, step: str, position: int | None = at, more: dict | None = None) -> str:
        text, found = lower(node, symbols, trace_length, position, more or bound, f"{path}.{step}")
        names.update(found)
        return text

    def literal(value: object) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        return f"#x{uint256.encode(int(value, 16) if isinstance(value, str) else value)}"

    if kind == "symbol":
        name = f"{raw['symbol_id']}@{raw['state']}" + ("" if at is None else f"@{at}")
        return f"|{name}|", {name: path}
    if kind == "literal":
        return literal(raw["value"]), {}
    if kind == "bound":
        return literal(bound[raw["variable"]]), {}
    if kind == "quantifier":
        parts = [child(raw["body"], f"body[{i}]", more={**bound, raw["variable"]: v["value"] if isinstance(v, dict) else v}) for i, v in enumerate(raw["domain"])]
        every = raw["operator"] == "forall"
        return (f"({'and' if every else 'or'} {' '.join(parts)})" if parts else str(every).lower()), names
    if kind == "temporal":
        if not trace_length:
            raise Refused(path, "no_trace", "temporal operators need a trace length")
        last = trace_length - 1 if at is None else at
        places = range(max(0, last - int(raw["horizon"])), last + 1) if raw["operator"] == "once" else range(trace_length)
        return f"({'or' if raw['operator'] == 'once' else 'and'} {' '.join(child(raw['operand'], f'operand[{i}]', i) for i in places)})", names
    operator = raw.get("operator")
    if kind == "unary":
        return f"({SOLVER[operator]} {child(raw['operand'], 'operand')})", names
    if operator in SIGNED_ORDER:
        word = SIGNED_ORDER[operator][_type_of(raw["left"], symbols) == "int256"]
    elif operator in SOLVER:
        word = SOLVER[operator]
    else:
        raise Refused(path, "unsupported_operator", str(operator))
    return f"({word} {child(raw['left'], 'left')} {child(raw['right'], 'right')})", names


def _type_of(raw: dict, symbols: dict[str, tuple[str, str]]) -> str | None:
    """The type of an integer operand, from its first leaf."""
    if raw["kind"] == "symbol":
        return symbols[raw["symbol_id"]][0]
    return raw["type"] if raw["kind"] in ("literal", "bound") else _type_of(raw.get("operand") or raw["left"], symbols)


def structure(proposal: dict, symbols: dict[str, tuple[str, str]], domains: tuple[str, ...] = ("source", "destination"), states: tuple[str, ...] = ("pre", "post"), allowed: set[str] | None = None) -> dict:
    """Structural legitimacy of a property, by a walk of its expanded tree: eligible, unwarranted or unknown, with the first reason; feasibility isn't judged."""
    found = references(expand(proposal["body"]))
    names = sorted({s for s, _ in found})
    seen, times = {symbols[s][1] for s in names if s in symbols}, {t for _, t in found}
    known = {"source", "destination", "shared"}
    if any(s not in symbols or symbols[s][1] not in known for s in names):
        status, reason = "unknown", "unsupported_symbol_domain"
    elif times - {"pre", "post"}:
        status, reason = "unknown", "unsupported_symbol_state"
    elif not names:
        status, reason = "unwarranted", "no_grounded_symbols"
    elif allowed is not None and not set(names) <= allowed:
        status, reason = "unwarranted", "symbol_outside_legitimacy_context"
    elif not set(domains) <= seen:
        status, reason = "unwarranted", "missing_required_domain"
    elif not set(states) <= times:
        status, reason = "unwarranted", "missing_required_state"
    else:
        status, reason = "eligible", "structural_policy_satisfied"
    return {"status": status, "reason": reason, "symbols": names, "domains": sorted(seen), "states": sorted(times), "cross_domain": {"source", "destination"} <= seen, "transition_relevant": {"pre", "post"} <= times}
