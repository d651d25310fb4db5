"""Plans many formulas together over one dense panel.

Equal sub-expressions, within and across formulas, are computed once. Operators are
staged by depth: all time windows of a stage share one partitioning by asset, all cross
sections one by bar, and all recurrences one grouped map. K formulas cost as many
shuffles as the deepest of them alternates between time and cross section.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.emit import Frame, cross, elementwise, hull_windows, rolling, running
from tessera.functions.recurrence import recurrence
from tessera.functions.specs import CROSS, CUM, ELEM, REC, TIME, Registry
from tessera.plans.formula import Node, column_of, parse

#: Assets of a recurrence that meet in one task are those of one bucket; a bucket has about so many bytes of the planned panel.
BUCKET_BYTES = 64 << 20
#: Bounds of the step of an adaptive average, of which its efficiency ratio chooses: those of averages over 2 and 30 bars.
FAST, SLOW = 2 / 3, 2 / 31



def _expand(node: Node, registry: Registry, kernel: bool) -> Node:
    """Aliases resolved, and the hull average written as its three weighted averages."""
    if node.op is None:
        return node
    spec = registry.spec(node.op)
    kids = tuple(_expand(c, registry, kernel) for c in node.children)
    op = (spec.alias_of if spec else None) or node.op
    if op == "HMA":
        half, root = hull_windows(int(node.param("window")))
        parts = [Node("WMA", kids, (("window", float(w)),)) for w in (half, int(node.param("window")))]
        if not kernel:
            parts = [Node("_Nz", (p,)) for p in parts]
        return Node("WMA", (Node("Sub", (Node("Mul", (Node(value=2.0), parts[0])), parts[1])),), (("window", float(root)),))
    return Node(op, kids, node.params)


def _kind(node: Node, registry: Registry) -> str:
    if node.op == "_Nz":
        return ELEM
    return registry.spec(node.op).kind


class Plan:
    """Columns for formulas over a dense panel with keys ``asset`` and ``t``."""

    def __init__(self, formulas: dict[str, str | Node], mode: str = "tree", registry: Registry | None = None, frame: Frame | None = None) -> None:
        if mode not in ("tree", "kernel"):
            raise ValueError("mode is tree or kernel")
        self.registry = registry or Registry()
        self.kernel = mode == "kernel"
        self.frame = frame or Frame()
        self.roots = {k: _expand(v if isinstance(v, Node) else parse(v, self.registry), self.registry, self.kernel) for k, v in formulas.items()}
        self._depth: dict[str, int] = {}
        self._names: dict[str, str] = {}

    @property
    def leaves(self) -> list[str]:
        """Columns of the panel that the formulas read: nothing else needs to be scanned."""
        return sorted({column_of(x) for r in self.roots.values() for x in r.leaves})

    def _depth_of(self, node: Node) -> int:
        key = str(node)
        if key not in self._depth:
            below = max((self._depth_of(c) for c in node.children), default=0)
            self._depth[key] = below + (node.op is not None and _kind(node, self.registry) != ELEM)
        return self._depth[key]

    def _column(self, node: Node) -> Column:
        """A node as a column: by name if it has been computed, else as an expression."""
        key = str(node)
        if key in self._names:
            return F.col(self._names[key])
        if node.leaf:
            return F.col(column_of(node.leaf))
        if node.op is None:
            return F.lit(float(node.value))
        args = [self._column(c) for c in node.children]
        if node.op in self.registry.own:
            return self.registry.own[node.op][1](*args, **dict(node.params))
        return elementwise(node.op, args, dict(node.params), self.kernel)

    def apply(self, panel: DataFrame) -> DataFrame:
        """``panel`` with one column for each formula."""
        kept = panel.columns
        nodes: dict[str, Node] = {}
        uses: dict[str, int] = {}
        for root in self.roots.values():
            for n in root.nodes():
                for c in n.children:
                    uses[str(c)] = uses.get(str(c), 0) + (str(n) not in nodes)
                nodes.setdefault(str(n), n)
        below_window = {str(c) for n in nodes.values() if n.op and _kind(n, self.registry) != ELEM for c in n.children}
        deepest = max((self._depth_of(r) for r in self.roots.values()), default=0)
        out = panel
        for stage in range(deepest + 1):
            if stage:
                out = self._windows(out, [n for n in nodes.values() if n.op and _kind(n, self.registry) != ELEM and self._depth_of(n) == stage])
            # projections that a later window reads, or that are used twice, become columns
            shared = [n for k, n in nodes.items() if n.op and _kind(n, self.registry) == ELEM and self._depth_of(n) == stage and (k in below_window or uses.get(k, 0) > 1)]
            for n in sorted(shared, key=lambda n: n.size):
                name = f"__f{len(self._names)}"
                out = out.withColumn(name, self._column(n))
                self._names[str(n)] = name
        return out.select(*kept, *[self._column(r).cast("double").alias(k) for k, r in self.roots.items()])

    def _windows(self, df: DataFrame, nodes: list[Node]) -> DataFrame:
        new: dict[str, Column] = {}
        loops: list[tuple[str, Node, str]] = []
        for n in sorted(nodes, key=lambda n: (_kind(n, self.registry) == CROSS, str(n))):
            kind, name = _kind(n, self.registry), f"__f{len(self._names)}"
            args = [self._column(c) for c in n.children]
            if kind == REC:
                source = f"{name}_in"
                df = df.withColumn(source, args[0].cast("double"))
                if n.op == "KAMA" and self.kernel:
                    df = self._with_step(df, source, int(n.param("window")))
                loops.append((name, n, source))
            elif kind == CUM:
                new[name] = running(n.op, args[0], self.frame, self.kernel)
            elif kind == TIME:
                new[name] = rolling(n.op, args, dict(n.params), self.frame, self.kernel)
            else:
                new[name] = cross(n.op, args[0], dict(n.params), self.frame, self.kernel)
            self._names[str(n)] = name
        if loops:
            df = self._recur(df, loops)
        return df.select("*", *[c.alias(k) for k, c in new.items()]) if new else df

    def _with_step(self, df: DataFrame, source: str, w: int) -> DataFrame:
        """``df`` with the step of an adaptive average: the net move over ``w`` bars by the path walked, put between SLOW and FAST, squared."""
        line = Window.partitionBy(self.frame.asset).orderBy(self.frame.t)
        x, legs = F.col(source), f"{source}_leg"
        df = df.withColumn(legs, F.coalesce(F.abs(x - F.lag(x).over(line)), F.lit(0.0)))
        walked, moved = F.sum(legs).over(line.rowsBetween(1 - w, 0)), F.abs(x - F.lag(x, w).over(line))
        ratio = F.when(walked > 1e-10, moved / walked).otherwise(0.0)
        return df.withColumn(f"{source}_step", F.pow(ratio * (FAST - SLOW) + SLOW, F.lit(2))).drop(legs)

    def _recur(self, df: DataFrame, loops: list[tuple[str, Node, str]]) -> DataFrame:
        """Recurrences of a bucket of assets as one matrix: a loop over bars, not over rows. Buckets follow the panel's size."""
        asset, t, kernel = self.frame.asset, self.frame.t, self.kernel
        steps = [(name, n.op, int(n.param("window")), source) for name, n, source in loops]
        schema = T.StructType([*df.schema.fields, *[T.StructField(s[0], T.DoubleType()) for s in steps]])
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES, 1 << 20) if size < 1 << 60 else 0)

        def run(table: pa.Table) -> pa.Table:
            table = table.drop_columns(["__bucket"]).sort_by([(asset, "ascending"), (t, "ascending")])
            codes = table.column(asset).combine_chunks().dictionary_encode()
            row = codes.indices.to_numpy(zero_copy_only=False)
            bar = table.column(t).to_numpy().astype(np.int64)
            shape = len(codes.dictionary), int(bar.max(initial=-1)) + 1
            for name, op, w, source in steps:
                x = np.full(shape, np.nan)
                x[row, bar] = table.column(source).to_numpy()
                step = None
                if f"{source}_step" in table.column_names:
                    step = np.full(shape, np.nan)
                    step[row, bar] = table.column(f"{source}_step").to_numpy()
                got = recurrence(op, x, w, kernel, step)[row, bar]
                table = table.append_column(name, pa.array(got, mask=np.isnan(got)))
            return table

        bucket = F.pmod(F.xxhash64(asset), F.lit(buckets)).alias("__bucket")
        return df.select("*", bucket).groupBy("__bucket").applyInArrow(run, schema)


def evaluate(panel: DataFrame, formulas: dict[str, str | Node], mode: str = "tree", registry: Registry | None = None, frame: Frame | None = None) -> DataFrame:
    """``panel`` (dense: every asset has every bar of ``t_idx``) with a column for each formula."""
    return Plan(formulas, mode, registry, frame).apply(panel)
