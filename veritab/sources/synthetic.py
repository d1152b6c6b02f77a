"""Seeded synthetic tables (S4): ``spark.range`` + per-column generators.

Each generator is a column expression over a seeded ``rand``/``randn``, so a
table of any size is produced in parallel on the executors, and the same seed
and partitioning give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(a: float, b: float) -> tuple:
    return ("uniform", a, b)


def normal(mean: float, std: float) -> tuple:
    return ("normal", mean, std)


def exponential(scale: float) -> tuple:
    return ("exponential", scale)


def choice(values: list, p: list[float] | None = None) -> tuple:
    return ("choice", list(values), p)


def as_int(gen: tuple) -> tuple:
    """Truncate a numeric generator to an integer (as ``astype(int)``)."""
    return ("int", gen)


def formatted_id(fmt: str, start: int = 1) -> tuple:
    """Row id through a printf format, e.g. 'CUST%05d'."""
    return ("id", fmt, start)


def _gen_expr(gen: tuple, seed: int) -> Column:
    kind = gen[0]
    if kind == "uniform":
        return F.lit(gen[1]) + F.rand(seed) * (gen[2] - gen[1])
    if kind == "normal":
        return F.lit(gen[1]) + F.randn(seed) * gen[2]
    if kind == "exponential":
        return -F.lit(gen[1]) * F.log1p(-F.rand(seed))
    if kind == "choice":
        values, p = gen[1], gen[2]
        u = F.rand(seed)
        if p is None:
            idx = F.least(F.floor(u * len(values)), F.lit(len(values) - 1)).cast("int")
            return F.element_at(F.array(*[F.lit(v) for v in values]), idx + 1)
        cum, expr = 0.0, None
        for v, pv in zip(values[:-1], p[:-1]):
            cum += pv
            expr = (F.when(u < cum, F.lit(v)) if expr is None else expr.when(u < cum, F.lit(v)))
        return expr.otherwise(F.lit(values[-1])) if expr is not None else F.lit(values[-1])
    if kind == "int":
        return _gen_expr(gen[1], seed).cast("long").cast("int")
    if kind == "id":
        return F.format_string(gen[1], F.col("id") + gen[2])
    raise ValueError(f"unknown generator {kind!r}")


def synthetic_table(spark: SparkSession, spec: dict[str, tuple] | str, n: int | None = None,
                    seed: int = 42, num_partitions: int | None = None) -> DataFrame:
    """Table of ``n`` rows from ``spec`` (column -> generator) or a preset name."""
    if isinstance(spec, str):
        preset_n, spec = PRESETS[spec.lower()]
        n = n or preset_n
    base = spark.range(0, n, numPartitions=num_partitions) if num_partitions else spark.range(n)
    cols = [_gen_expr(g, seed + i).alias(name) for i, (name, g) in enumerate(spec.items())]
    return base.select(*cols)


# The reference's five preset tables (rows, column generators).
YES_NO = ["Yes", "No"]
YES_NO_NET = ["Yes", "No", "No internet service"]
PRESETS: dict[str, tuple[int, dict[str, tuple]]] = {
    "iris": (150, {
        "sepal_length": uniform(4.0, 7.0), "sepal_width": uniform(2.0, 4.5),
        "petal_length": uniform(1.0, 6.0), "petal_width": uniform(0.1, 2.5),
        "species": choice(["setosa", "versicolor", "virginica"]),
    }),
    "boston_housing": (506, {
        "CRIM": exponential(0.3), "ZN": uniform(0, 100), "INDUS": uniform(0, 30),
        "CHAS": choice([0, 1]), "NOX": uniform(0.3, 0.9), "RM": normal(6.5, 0.7),
        "AGE": uniform(10, 100), "DIS": uniform(1, 10), "RAD": choice(list(range(1, 25))),
        "TAX": uniform(100, 800), "PTRATIO": uniform(10, 25), "B": uniform(0, 400),
        "LSTAT": uniform(1, 40), "MEDV": uniform(5, 50),
    }),
    "wine_quality": (1000, {
        "fixed_acidity": normal(8.0, 1.0), "volatile_acidity": normal(0.5, 0.2),
        "citric_acid": normal(0.3, 0.1), "residual_sugar": exponential(2.0),
        "chlorides": normal(0.08, 0.02), "free_sulfur_dioxide": normal(30, 10),
        "total_sulfur_dioxide": normal(120, 30), "density": normal(0.997, 0.001),
        "pH": normal(3.2, 0.2), "sulphates": normal(0.6, 0.1), "alcohol": normal(10.5, 1.0),
        "quality": choice(list(range(3, 9))),
    }),
    "diabetes": (768, {
        "Pregnancies": choice(list(range(0, 18))), "Glucose": normal(120, 30),
        "BloodPressure": normal(70, 10), "SkinThickness": normal(20, 10),
        "Insulin": exponential(80), "BMI": normal(32, 6),
        "DiabetesPedigreeFunction": exponential(0.4), "Age": normal(35, 10),
        "Outcome": choice([0, 1], [0.65, 0.35]),
    }),
    "customer_churn": (200, {
        "customer_id": formatted_id("CUST%05d"), "age": as_int(normal(40, 15)),
        "tenure": as_int(normal(30, 20)), "monthly_charges": normal(70, 30),
        "total_charges": normal(2000, 1500), "gender": choice(["Male", "Female"]),
        "partner": choice(YES_NO), "dependents": choice(YES_NO), "phone_service": choice(YES_NO),
        "multiple_lines": choice(["Yes", "No", "No phone service"]),
        "internet_service": choice(["DSL", "Fiber optic", "No"]),
        "online_security": choice(YES_NO_NET), "online_backup": choice(YES_NO_NET),
        "device_protection": choice(YES_NO_NET), "tech_support": choice(YES_NO_NET),
        "streaming_tv": choice(YES_NO_NET), "streaming_movies": choice(YES_NO_NET),
        "contract": choice(["Month-to-month", "One year", "Two year"]),
        "paperless_billing": choice(YES_NO),
        "payment_method": choice(["Electronic check", "Mailed check", "Bank transfer", "Credit card"]),
        "churn": choice(YES_NO, [0.3, 0.7]),
    }),
}
PRESETS["boston"] = PRESETS["boston_housing"]
PRESETS["wine"] = PRESETS["wine_quality"]
