"""Business metrics over the marts.

A semantic model describes one fact: its time column, its measures and the entities it references. A metric is one
measure or a ratio of two simple metrics. ``MetricLayer.query`` aggregates every fact on its own first, joins the
aggregates on the requested dimensions and divides last, so a metric over two facts cannot multiply rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.dates import GRAINS, trunc_to
from tillmark.functions.money import safe_ratio
from tillmark.functions.ordering import by
from tillmark.operators import aggregates
from tillmark.operators.joins import Aggregate, facts_together
from tillmark.sources.sinks import MONTH, split_by

DATE_FIELDS = ("date", "metric_time")
ISO_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


class MetricError(ValueError):
    """The request names something that does not exist; the message lists what does."""


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    expression: Callable[[], Column]


@dataclass(frozen=True)
class Reference:
    """A foreign entity: the fact's key column, and dimension attributes that the fact already carries itself."""

    entity: str
    column: str
    carried: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class SemanticModel:
    name: str
    relation: str
    entity: str
    key: str
    time: str | None = None
    dimensions: tuple[str, ...] = ()
    references: tuple[Reference, ...] = ()
    measures: tuple[Measure, ...] = ()


@dataclass(frozen=True)
class Metric:
    name: str
    label: str
    description: str
    measure: str | None = None
    ratio: tuple[str, str] | None = None


@dataclass(frozen=True)
class Filter:
    dimension: str
    op: str
    value: object


@dataclass(frozen=True)
class Attribute:
    """A dimension as one fact reaches it: ``key`` is None when the column is the fact's own."""

    qualified: str
    column: str
    model: str | None = None
    key: str | None = None
    foreign_key: str | None = None

    @property
    def alias(self) -> str:
        return ALIAS_OF.get(self.qualified, self.qualified)


# Short dimension names and what they stand for.
ALIASES = {
    "region": "region__region_name",
    "country": "region__country",
    "product_category": "product__product_category",
    "sales_channel": "sales_channel__channel_name",
    "marketing_channel": "marketing_channel__channel_name",
    "carrier": "shipment__carrier",
}
ALIAS_OF = {qualified: alias for alias, qualified in ALIASES.items()}

HEADLINE = ("revenue", "gross_margin", "average_order_value", "roas", "on_time_delivery_rate")


def _column(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _if(condition: Callable[[], Column], value: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.when(condition(), value()).otherwise(F.lit(0))


def _is_sale() -> Column:
    return F.col("order_type") == "sale"


def _is_credited() -> Column:
    return F.col("is_paid_attribution") & _is_sale()


def _one() -> Column:
    return F.lit(1)


_REGION = Reference("region", "region_code")
_CHANNEL = Reference("sales_channel", "sales_channel")
_MARKETING = Reference("marketing_channel", "marketing_channel")

MODELS = (
    SemanticModel(
        name="sales_lines",
        relation="fct_sales_lines",
        entity="sales_line",
        key="sales_line_id",
        time="order_date",
        references=(
            # the fact repeats its product's category, which spares a shuffle join with the products
            Reference("product", "product_id", carried={"product_category": "product_category"}),
            _REGION,
            _CHANNEL,
        ),
        measures=(
            Measure("revenue", "sum", _column("revenue_nzd")),
            Measure("gross_profit", "sum", _column("gross_profit_nzd")),
            Measure("costed_revenue", "sum", _if(_column("has_cost"), _column("revenue_nzd"))),
            Measure("units", "sum", _column("quantity")),
        ),
    ),
    SemanticModel(
        name="orders",
        relation="attributed_orders",
        entity="order",
        key="order_id",
        time="order_date",
        references=(_REGION, _CHANNEL, _MARKETING),
        measures=(
            Measure("sale_orders", "sum", _if(_is_sale, _one)),
            Measure("sale_order_revenue", "sum", _if(_is_sale, _column("revenue_nzd"))),
            Measure("attributed_revenue", "sum", _if(_is_credited, _column("revenue_nzd"))),
        ),
    ),
    SemanticModel(
        name="ad_spend",
        relation="fct_ad_spend",
        entity="spend_line",
        key="spend_id",
        time="spend_date",
        references=(_REGION, _MARKETING),
        measures=(Measure("ad_spend", "sum", lambda: F.col("spend_nzd").cast("decimal(28,10)")),),
    ),
    SemanticModel(
        name="shipments",
        relation="fct_shipments",
        entity="shipment",
        key="shipment_id",
        time="promised_date",
        dimensions=("carrier",),
        references=(_REGION, _CHANNEL),
        measures=(
            Measure("shipments_due", "sum", _one),
            Measure("on_time_shipments", "sum", _if(_column("is_on_time"), _one)),
        ),
    ),
    SemanticModel("regions", "dim_regions", "region", "region_code", dimensions=("region_name", "country")),
    SemanticModel("products", "dim_products", "product", "product_id", dimensions=("product_category",)),
    SemanticModel(
        "sales_channels", "dim_sales_channels", "sales_channel", "sales_channel", dimensions=("channel_name",)
    ),
    SemanticModel(
        "marketing_channels",
        "dim_marketing_channels",
        "marketing_channel",
        "marketing_channel",
        dimensions=("channel_name",),
    ),
)

METRICS = (
    Metric("revenue", "Revenue (NZD)", "Net of refunds, without shipping fees and cancelled web orders.", "revenue"),
    Metric("gross_profit", "Gross profit (NZD)", "Revenue less standard cost where the cost is known.", "gross_profit"),
    Metric("costed_revenue", "Costed revenue (NZD)", "Revenue of lines with a known cost.", "costed_revenue"),
    Metric("gross_margin", "Gross margin", "Gross profit over costed revenue.", ratio=("gross_profit", "costed_revenue")),
    Metric("units_sold", "Units sold", "Net of units refunded.", "units"),
    Metric("orders", "Orders", "Sale orders of all channels.", "sale_orders"),
    Metric("order_revenue", "Order revenue (NZD)", "Revenue of sale orders.", "sale_order_revenue"),
    Metric("average_order_value", "Average order value (NZD)", "Per sale order.", ratio=("order_revenue", "orders")),
    Metric("ad_spend", "Ad spend (NZD)", "Cost of paid media.", "ad_spend"),
    Metric("attributed_revenue", "Attributed revenue (NZD)", "Sale orders credited to paid media.", "attributed_revenue"),
    Metric("roas", "Return on ad spend", "Attributed revenue over spend.", ratio=("attributed_revenue", "ad_spend")),
    Metric("shipments_due", "Shipments due", "By promised date.", "shipments_due"),
    Metric("on_time_shipments", "On-time shipments", "Delivered by the promised date.", "on_time_shipments"),
    Metric(
        "on_time_delivery_rate", "On-time delivery rate", "Of shipments due.", ratio=("on_time_shipments", "shipments_due")
    ),
)

COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    "in": lambda c, v: c.isin(*_several(v)),
    "not in": lambda c, v: ~c.isin(*_several(v)),
    ">": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
}


def _several(value: object) -> list[object]:
    return list(value) if isinstance(value, list | tuple | set) else [value]


class MetricLayer:
    """Metrics over the given relations (by name), for example stored marts or a ``Models`` object's attributes."""

    def __init__(
        self,
        relation: Callable[[str], DataFrame],
        models: Sequence[SemanticModel] = MODELS,
        metrics: Sequence[Metric] = METRICS,
    ) -> None:
        self.relation = relation
        self.models = {m.name: m for m in models}
        self.metrics = {m.name: m for m in metrics}
        self._owner = {measure.name: m for m in models for measure in m.measures}

    # names

    def metric(self, name: str) -> Metric:
        if name not in self.metrics:
            raise MetricError(f"Unknown metric '{name}'. Available: {', '.join(self.metrics)}")
        return self.metrics[name]

    def measures_of(self, metric: Metric) -> list[str]:
        parts = [metric] if metric.ratio is None else [self.metric(p) for p in metric.ratio]
        return [p.measure for p in parts if p.measure]

    def attributes(self, model: SemanticModel) -> dict[str, Attribute]:
        """What a fact can be grouped by: its own dimensions and those one reference away."""
        found = {f"{model.entity}__{d}": Attribute(f"{model.entity}__{d}", d) for d in model.dimensions}
        for ref in model.references:
            for other in self.models.values():
                if other.entity != ref.entity or other is model:
                    continue
                for d in other.dimensions:
                    name = f"{ref.entity}__{d}"
                    found[name] = (
                        Attribute(name, ref.carried[d])
                        if d in ref.carried
                        else Attribute(name, d, other.name, other.key, ref.column)
                    )
        return found

    def dimensions_of(self, metric: Metric) -> list[str]:
        """Qualified names shared by every fact of the metric."""
        reachable = [self.attributes(self._owner[m]) for m in self.measures_of(metric)]
        return [name for name in reachable[0] if all(name in r for r in reachable)]

    def resolve(self, name: str, metrics: Sequence[Metric]) -> str:
        qualified = ALIASES.get(name, name)
        for metric in metrics:
            valid = self.dimensions_of(metric)
            if qualified not in valid:
                choices = ", ".join(ALIAS_OF.get(v, v) for v in valid)
                raise MetricError(
                    f"Dimension '{name}' is not available for metric '{metric.name}'. Valid: date, {choices}"
                )
        return qualified

    # requests

    def frame(
        self,
        metrics: Sequence[str],
        group_by: Sequence[str] = (),
        grain: str = "month",
        start: str | None = None,
        end: str | None = None,
        filters: Sequence[Filter] = (),
    ) -> DataFrame:
        """The metrics by the requested columns: all rows, in no order."""
        if not metrics:
            raise MetricError("Ask for at least one metric.")
        wanted = [self.metric(m) for m in metrics]
        if grain not in GRAINS:
            raise MetricError(f"grain must be one of {', '.join(GRAINS)}")
        for day in (start, end):
            if day is not None and not ISO_DATE.fullmatch(day):
                raise MetricError(f"Dates must be YYYY-MM-DD, got '{day}'")
        fields = list(dict.fromkeys(group_by))
        dated = any(f in DATE_FIELDS for f in fields)
        dims = [self.resolve(f, wanted) for f in fields if f not in DATE_FIELDS]
        checked = [self._checked(f, wanted) for f in filters]

        facts: dict[str, list[str]] = {}
        for metric in wanted:
            for measure in self.measures_of(metric):
                listed = facts.setdefault(self._owner[measure].name, [])
                if measure not in listed:
                    listed.append(measure)
        keys = (["date"] if dated else []) + [ALIAS_OF.get(d, d) for d in dims]
        parts = [
            self._aggregate(self.models[name], measures, dims, grain if dated else None, start, end, checked)
            for name, measures in facts.items()
        ]
        return facts_together(parts, keys).select(*keys, *(self._value(m).alias(m.name) for m in wanted))

    def query(
        self,
        metrics: Sequence[str],
        group_by: Sequence[str] = (),
        grain: str = "month",
        start: str | None = None,
        end: str | None = None,
        filters: Sequence[Filter] = (),
        order_by: Sequence[tuple[str, bool]] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """``frame`` for a reader: ordered (NULL last), all rows or the first ``limit``."""
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
            raise MetricError(f"limit must be a whole number of at least 1, got {limit!r}")
        out = self.frame(metrics, group_by, grain, start, end, filters)
        for name, _ in order_by:
            if name not in out.columns:
                raise MetricError(f"order_by field '{name}' must be one of {', '.join(out.columns)}")
        keys = [c for c in out.columns if c not in metrics]
        order = list(order_by) or [(k, False) for k in keys]
        ordered = out.orderBy(*by(order)) if order else out
        return ordered if limit is None else ordered.limit(limit)

    def conditional(
        self, requests: Mapping[str, tuple[str, str, str, Sequence[Filter]]], group_by: str | None = None
    ) -> DataFrame:
        """Many (metric, start, end, filters) requests with one grouping, in one pass per fact: a column ``answer_<name>`` each."""
        metrics = {name: self.metric(r[0]) for name, r in requests.items()}
        dims = [self.resolve(group_by, list(metrics.values()))] if group_by else []
        facts: dict[str, dict[str, tuple[str, Column]]] = {}
        needed: dict[str, list[str]] = {}
        for name, (_, start, end, filters) in requests.items():
            checked = [self._checked(f, [metrics[name]]) for f in filters]
            for measure in self.measures_of(metrics[name]):
                model = self._owner[measure]
                condition = F.col("_time").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
                for qualified, f in checked:
                    condition = condition & COMPARISONS[f.op](F.col(qualified), f.value)
                facts.setdefault(model.name, {})[f"_{name}_{measure}"] = (measure, condition)
                needed.setdefault(model.name, []).extend([*dims, *(q for q, _ in checked)])
        first, last = min(r[1] for r in requests.values()), max(r[2] for r in requests.values())
        parts = []
        for name, columns in facts.items():
            model = self.models[name]
            measures = [m for m in model.measures if m.name in {measure for measure, _ in columns.values()}]
            rows = self._rows(model, measures, list(dict.fromkeys(needed[name])), None, first, last)
            by_name = {m.name: m for m in measures}
            aggs = {
                column: (self._if_any(by_name[measure].agg), F.when(condition, F.struct(F.col(measure).alias("value"))))
                for column, (measure, condition) in columns.items()
            }
            parts.append((rows, aggs))
        joined = facts_together(parts, dims)

        def value(name: str) -> Column:
            parts_ = [F.col(f"`_{name}_{m}`") for m in self.measures_of(metrics[name])]
            return parts_[0] if len(parts_) == 1 else safe_ratio(*parts_)

        return joined.select(
            *(F.col(d).alias(ALIAS_OF.get(d, d)) for d in dims), *(value(name).alias(f"answer_{name}") for name in requests)
        )

    def _checked(self, f: Filter, metrics: Sequence[Metric]) -> tuple[str, Filter]:
        if f.op not in COMPARISONS:
            raise MetricError(f"Filter op must be one of {', '.join(COMPARISONS)}")
        if f.dimension in DATE_FIELDS:
            raise MetricError("Filter by date with start and end.")
        if f.op in ("in", "not in"):
            if not _several(f.value):
                raise MetricError(f"Filter on {f.dimension} needs at least one value")
        elif isinstance(f.value, list | tuple | set):
            raise MetricError(f"Filter op '{f.op}' takes a single value")
        return self.resolve(f.dimension, metrics), f

    def _rows(
        self,
        model: SemanticModel,
        measures: Sequence[Measure],
        qualified: Sequence[str],
        grain: str | None,
        start: str | None,
        end: str | None,
    ) -> DataFrame:
        """One fact in a period with measures and attributes. A dimension is joined only when used, and once."""
        fact = self.relation(model.relation)
        time = F.col(model.time)
        if start:
            fact = fact.filter(time >= F.lit(start).cast("date"))
        if end:
            fact = fact.filter(time <= F.lit(end).cast("date"))
        if MONTH in fact.columns and model.time == split_by(model.relation):  # skips whole folders of a stored fact
            if start:
                fact = fact.filter(F.col(MONTH) >= F.trunc(F.lit(start).cast("date"), "month"))
            if end:
                fact = fact.filter(F.col(MONTH) <= F.trunc(F.lit(end).cast("date"), "month"))
        attributes = self.attributes(model)
        used = [attributes[q] for q in qualified]
        own = [F.col(a.column).alias(a.qualified) for a in used if a.model is None]
        foreign = list(dict.fromkeys(a.foreign_key for a in used if a.foreign_key))
        rows = fact.select(
            time.alias("_time"),
            *([trunc_to(grain, time).alias("date")] if grain else []),
            *own,
            *(F.col(k).alias(f"_key_{k}") for k in foreign),
            *(m.expression().alias(m.name) for m in measures),
        )
        for key in foreign:
            through = [a for a in used if a.foreign_key == key]
            other = self.relation(self.models[through[0].model].relation).select(
                F.col(through[0].key).alias(f"_key_{key}"), *(F.col(a.column).alias(a.qualified) for a in through)
            )
            rows = rows.join(other, [f"_key_{key}"], "left")
        return rows

    def _aggregate(
        self,
        model: SemanticModel,
        measures: Sequence[str],
        dims: Sequence[str],
        grain: str | None,
        start: str | None,
        end: str | None,
        filters: Sequence[tuple[str, Filter]],
    ) -> tuple[DataFrame, dict[str, Aggregate]]:
        """The rows of one fact, and the aggregates that are asked of it."""
        chosen = [m for m in model.measures if m.name in measures]
        used = list(dict.fromkeys([*dims, *(q for q, _ in filters)]))
        rows = self._rows(model, chosen, used, grain, start, end)
        for qualified, f in filters:
            rows = rows.filter(COMPARISONS[f.op](F.col(qualified), f.value))
        named = rows.withColumnsRenamed({q: ALIAS_OF.get(q, q) for q in dims}) if dims else rows
        return named, {f"_m_{m.name}": (partial(aggregates.measure, m.agg), F.col(m.name)) for m in chosen}

    @staticmethod
    def _if_any(agg: str) -> Callable[[Column], Column]:
        """The aggregate of the values of a struct column, NULL if no row has one."""
        return lambda rows: F.when(F.count(rows) > 0, aggregates.measure(agg, rows["value"]))

    def _value(self, metric: Metric) -> Column:
        if metric.ratio is None:
            return F.col(f"_m_{metric.measure}")
        top, bottom = (F.col(f"_m_{self.metric(p).measure}") for p in metric.ratio)
        return safe_ratio(top, bottom)
