"""The data model: function rows, the token alphabet, and the knobs of an analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import col

#: Token names by code; codes from 22 on occur in Java only. Shape keys and hashes depend on the numbers.
TOKENS = (
    "IF FOR RANGE SWITCH CASE SELECT COMM RETURN GO SEND DEFER CONTINUE BREAK GOTO CALL FUNCLIT ASSIGN CALL_PKG CALL_METHOD "
    "COMPOSITE_LIT BINARY_OP TYPE_ASSERT TRY CATCH THROW FINALLY SYNCHRONIZED WHILE DO_WHILE ASSERT_STMT"
).split()
CODE = {name: i for i, name in enumerate(TOKENS)}

CONTROL_FLOW = ("if", "for", "range", "switch", "select", "return", "defer", "go", "send", "continue", "break", "goto")
FEATURES = T.StructType(
    [
        *[T.StructField(x, T.IntegerType()) for x in ("cyclomatic_complexity", "branching_depth", "nesting_depth", "early_returns")],
        T.StructField("control_flow", T.StructType([T.StructField(x, T.IntegerType()) for x in CONTROL_FLOW])),
        *[T.StructField(x, T.IntegerType()) for x in ("outbound_calls", "func_literal_count", "goroutine_spawns", "param_count", "return_count")],
        *[T.StructField(x, T.BooleanType()) for x in ("has_func_param", "has_context_param", "has_error_return")],
    ]
)
_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
PARAMS = T.ArrayType(T.StructType([T.StructField("type_name", _S), T.StructField("is_func_type", _B), T.StructField("is_interface", _B)]))
RETURNS = T.ArrayType(T.StructType([T.StructField("type_name", _S), T.StructField("is_error", _B)]))
FUNCTIONS = T.StructType(
    [
        T.StructField("fn_id", T.LongType()),
        *[T.StructField(x, _S) for x in ("name", "package", "file_name", "file_path", "lang")],
        *[T.StructField(x, _I) for x in ("start_line", "end_line", "line_count")],
        *[T.StructField(x, _B) for x in ("is_method", "is_exported")],
        T.StructField("receiver", _S), T.StructField("params", PARAMS), T.StructField("returns", RETURNS), T.StructField("features", FEATURES),
        T.StructField("token_seq", T.ArrayType(_I)), T.StructField("token_seq_hash", T.ArrayType(T.LongType())),
        *[T.StructField(x, T.ArrayType(_S)) for x in ("call_targets", "imports", "direct_imports")],
        *[T.StructField(x, _B) for x in ("generated_code", "test_code", "is_constructor")],
        T.StructField("body", _S),
    ]
)


@dataclass(frozen=True)
class Config:
    """All knobs of clustering and near-miss scoring, with their defaults."""

    identify_threshold: float = 0.75
    seq_similarity_threshold: float = 0.40
    max_bucket: int = 300
    min_token_seq_len: int = 5
    identify_min_size: int = 3
    primitive_threshold: float = 0.05
    seq_fast_reject: float = 0.30
    tolerance_k: float = 1.5
    tolerance_shrink_k: float = 5.0
    high_tier: float = 0.05
    medium_tier: float = 0.12
    #: What the reference run does where it departs from its own intent: self-pairs count towards "almost joined", merges stop at .75,
    #: and coherence is of every (n div 50)-th member.
    compat: bool = False

    def text(self) -> str:
        return f"IT={self.identify_threshold:.2f}|SS={self.seq_similarity_threshold:.2f}|MB={self.max_bucket}"


def zero(kind: T.DataType):
    """The value of a field that isn't there: there are no nulls in function rows."""
    if isinstance(kind, T.StructType):
        return F.struct(*[zero(f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit({"string": "", "boolean": False}.get(kind.simpleString(), 0)).cast(kind)


def complete(df: DataFrame) -> DataFrame:
    """``df`` with all columns of FUNCTIONS: missing ones and nulls get zero values, sets are sorted and without repeats, and the
    window hashes are made from the tokens where there is no column of them. Other columns go. A null fn_id stays null."""
    from .functions.scalars import window_hashes

    have = {c.lower(): c for c in df.columns}
    out = []
    for f in FUNCTIONS.fields:
        c = have.get(f.name.lower())
        if f.name == "token_seq_hash" and c is None:
            out.append(window_hashes(F.coalesce(col(have["token_seq"]), zero(T.ArrayType(_I))) if "token_seq" in have else zero(T.ArrayType(_I))).alias(f.name))
            continue
        if c is None:
            value = zero(f.dataType)
        elif isinstance(f.dataType, T.StructType):
            value = F.coalesce(col(c), zero(df.schema[c].dataType))
        else:
            value = col(c).cast(f.dataType)
            value = value if f.name == "fn_id" else F.coalesce(value, zero(f.dataType))
        if f.name in ("direct_imports", "call_targets"):
            value = F.array_sort(F.array_distinct(F.array_compact(value)))
        out.append(value.alias(f.name))
    return df.select(*out)
