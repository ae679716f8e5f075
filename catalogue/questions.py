"""Business questions about the test data, made by rule: every year, the headline metrics, and label questions."""

from __future__ import annotations

from tillmark.plans.scoring import Question


def _year(year: int) -> list[Question]:
    start, end = f"{year}-01-01", f"{year}-12-31"
    split = "holdout" if year == 1998 else "dev"

    def ask(tag: str, metric: str, **more: object) -> Question:
        return Question(f"q{year}_{tag}", split, metric, start, end, **more)

    return [
        ask("revenue", "revenue"),
        ask("online", "revenue", filters={"sales_channel": "online"}),
        ask("sydney_store", "revenue", filters={"sales_channel": "store", "region": "Sydney"}),
        ask("margin_bakeware", "gross_margin", filters={"product_category": "Bakeware"}),
        ask("aov_wholesale", "average_order_value", filters={"sales_channel": "wholesale"}),
        ask("orders", "orders"),
        ask("on_time", "on_time_delivery_rate", filters={"country": "AU"}),
        ask("best_category", "revenue", argmax="product_category"),
        ask("weak_region", "revenue", argmin="region"),
        ask("best_carrier", "on_time_delivery_rate", argmax="carrier"),
    ]


QUESTIONS = [
    *(q for year in (1996, 1998, 2000) for q in _year(year)),
    Question("q_roas", "dev", "roas", "1999-01-01", "1999-01-31"),
    Question("q_roas_email", "dev", "roas", "1999-01-01", "1999-01-31", {"marketing_channel": "email"}),
    Question("q_roas_best", "dev", "roas", "1999-01-01", "1999-01-31", argmax="marketing_channel"),
    Question("q_roas_weak", "holdout", "roas", "1999-01-01", "1999-01-31", argmin="marketing_channel"),
    Question("q_spend", "dev", "ad_spend", "1999-01-01", "1999-01-15", {"country": "NZ"}),
]
