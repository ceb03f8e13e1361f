"""The same portfolio and stages as SQL common table expressions, written independently of the operators."""

from __future__ import annotations

from premiumscope.functions.labels import COVERAGE_LABELS

EPS = "2.220446049250313e-16"
LABEL_ROWS = ", ".join(f"({number}, '{label}')" for number, label in COVERAGE_LABELS.items())

PORTFOLIO = """
cents AS (
  SELECT l.*, p.*, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(ROUND(l_tax * 100) AS BIGINT) AS tax, CAST(ROUND(l_discount * 100) AS BIGINT) AS disc
  FROM lineitem l JOIN part p ON l_partkey = p_partkey
),
parts AS (
  SELECT *, cents * 4 // 100 AS c1, cents * tax // 100 AS c2, cents * disc // 1000 AS c3,
         CASE WHEN l_partkey % 151 = 0 THEN -100 ELSE CAST(l_quantity AS INTEGER) * 50 END AS c4
  FROM cents
),
portfolio AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cents) AS NroPoliza,
         l_returnflag AS Pol6TTaCod,
         CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE p_size END AS Cobertura,
         CASE WHEN l_suppkey % 13 = 0 THEN NULL
              ELSE concat(CAST(p_size % 5 AS VARCHAR), '.0, ', replace(p_name, ' ', ', '), ',,') END AS Accesorios,
         CAST(2002 - year(l_shipdate) AS INTEGER) AS antig,
         l_tax AS TasaCasco,
         CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_discount END AS FactorCasco,
         CAST(cents AS DOUBLE) / 100 AS SumaAsegurada,
         CAST(l_linenumber AS VARCHAR) AS ModoFacturacion,
         p_brand AS Marca,
         CAST(c1 AS DOUBLE) / 100 AS PrimaRC,
         CAST(c2 AS DOUBLE) / 100 AS PrimaCasco,
         CAST(c3 AS DOUBLE) / 100 AS PrimaClausulaAjuste,
         CAST(c4 AS DOUBLE) / 100 AS PrimaAccesorio,
         CAST(c1 + c2 + c3 + c4 + CASE WHEN l_partkey % 97 = 0 THEN 100 ELSE 0 END AS DOUBLE) / 100 AS Prima
  FROM parts
)"""

LABELLED = f"""
labels_by_number(number, label) AS (VALUES {LABEL_ROWS}),
labelled AS (
  SELECT p.* EXCLUDE (Cobertura, Pol6TTaCod), coalesce(Pol6TTaCod, 'Missing') AS Pol6TTaCod,
         coalesce(d.label, CAST(Cobertura AS VARCHAR), 'Missing') AS CoberturaLabel
  FROM portfolio p LEFT JOIN labels_by_number d ON p.Cobertura = d.number
)"""

CHECKED = """
checked AS (
  SELECT *, Prima - (PrimaRC + PrimaCasco + PrimaClausulaAjuste + PrimaAccesorio) AS difference,
         abs(Prima - (PrimaRC + PrimaCasco + PrimaClausulaAjuste + PrimaAccesorio)) <= 0.02::DOUBLE + 1e-9 AS sum_ok,
         PrimaRC >= 0 AND PrimaCasco >= 0 AND PrimaClausulaAjuste >= 0 AND PrimaAccesorio >= 0 AND Prima >= 0 AS nonneg,
         CoberturaLabel <> 'Missing' AS has_coverage
  FROM labelled
),
eligible AS (
  SELECT Pol6TTaCod, CoberturaLabel, count(*) AS eligible FROM checked
  WHERE sum_ok AND nonneg AND has_coverage GROUP BY ALL
),
counted AS (
  SELECT c.*, coalesce(e.eligible, 0) AS pair_count
  FROM checked c LEFT JOIN eligible e USING (Pol6TTaCod, CoberturaLabel)
),
clean AS (
  SELECT * EXCLUDE (difference, sum_ok, nonneg, has_coverage, pair_count) FROM counted
  WHERE sum_ok AND nonneg AND has_coverage AND pair_count >= 20
)"""

SPLIT = """
keyed AS (
  SELECT *, Pol6TTaCod || chr(31) || CoberturaLabel AS stratum, md5(concat_ws('|', '42', NroPoliza)) AS key FROM clean
),
strata AS (SELECT stratum, count(*) AS n FROM keyed GROUP BY stratum),
sizes AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(ceil(sum(n) * 0.2::DOUBLE) AS BIGINT) AS test_rows FROM strata),
shares AS (
  SELECT stratum, n, test_rows, CAST(n AS HUGEINT) * test_rows // total AS base,
         row_number() OVER (ORDER BY CAST(n AS HUGEINT) * test_rows % total DESC, stratum) AS place
  FROM strata, sizes
),
quotas AS (
  SELECT stratum, n, base + CASE WHEN place <= test_rows - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM shares
),
split AS (
  SELECT k.*, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY key) <= quota THEN 'test' ELSE 'train' END
         AS "Dataset Split"
  FROM keyed k JOIN quotas USING (stratum)
)"""

FOLDS = """
fold_strata AS (
  SELECT stratum, n, CAST(coalesce(sum(n) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row
  FROM strata
),
fold_ranks AS (
  SELECT k.*, n, first_row, row_number() OVER (PARTITION BY stratum ORDER BY key) - 1 AS r FROM keyed k JOIN fold_strata USING (stratum)
),
folded AS (
  SELECT *, CAST((first_row + CASE WHEN r < (n % 3) * (n // 3 + 1) THEN r // (n // 3 + 1)
                  ELSE n % 3 + (r - (n % 3) * (n // 3 + 1)) // (n // 3) END) % 3 AS INTEGER) AS Fold
  FROM fold_ranks
)"""


def _mean(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(20, 2))) AS DOUBLE) / count({column})"


COMPONENTS = ("PrimaRC", "PrimaCasco", "PrimaClausulaAjuste", "PrimaAccesorio")
PREDICTIONS = tuple(f'"{c} Prediction"' for c in COMPONENTS)

SCORED = f"""
pair_means AS (
  SELECT stratum, {", ".join(f'{_mean(c)} AS "{c} Prediction"' for c in COMPONENTS)}
  FROM split WHERE "Dataset Split" = 'train' GROUP BY stratum
),
predicted AS (
  SELECT s.*, {", ".join(PREDICTIONS)}, {" + ".join(PREDICTIONS)} AS Prediction FROM split s JOIN pair_means USING (stratum)
),
scored AS (
  SELECT * EXCLUDE (stratum, key),
         CASE WHEN abs(Prima) > {EPS} THEN abs(Prima - Prediction) / abs(Prima) * 100 END AS "Absolute Percent Error"
  FROM predicted
)"""

COUNTERFACTUAL = """
numeric_clean AS (SELECT * REPLACE (coalesce(FactorCasco, 0) AS FactorCasco) FROM clean),
selected AS (
  SELECT *, TasaCasco * 1.15::DOUBLE AS TasaCasco_Counterfactual FROM numeric_clean
  WHERE antig BETWEEN 2 AND 5 AND Pol6TTaCod = 'R'
),
priced AS (
  SELECT *, SumaAsegurada * 0.04::DOUBLE AS PrimaRC_Baseline,
         SumaAsegurada * TasaCasco AS PrimaCasco_Baseline,
         SumaAsegurada * FactorCasco * 0.1::DOUBLE AS PrimaClausulaAjuste_Baseline,
         antig * 5::DOUBLE + 10::DOUBLE AS PrimaAccesorio_Baseline,
         SumaAsegurada * 0.04::DOUBLE * 1.1::DOUBLE AS PrimaRC_Counterfactual,
         SumaAsegurada * TasaCasco_Counterfactual AS PrimaCasco_Counterfactual,
         SumaAsegurada * FactorCasco * 0.1::DOUBLE AS PrimaClausulaAjuste_Counterfactual,
         antig * 5::DOUBLE + 10::DOUBLE AS PrimaAccesorio_Counterfactual
  FROM selected
),
counterfactual AS (
  SELECT *, PrimaRC_Baseline + PrimaCasco_Baseline + PrimaClausulaAjuste_Baseline + PrimaAccesorio_Baseline AS Prima_Baseline,
         PrimaRC_Counterfactual + PrimaCasco_Counterfactual + PrimaClausulaAjuste_Counterfactual + PrimaAccesorio_Counterfactual
         AS Prima_Counterfactual
  FROM priced
),
changes AS (
  SELECT *, Prima_Counterfactual - Prima_Baseline AS change,
         CASE WHEN abs(Prima_Baseline) > 2.220446049250313e-16
              THEN (Prima_Counterfactual - Prima_Baseline) / Prima_Baseline * 100 END AS percent
  FROM counterfactual
)"""

STAGES = ", ".join([PORTFOLIO, LABELLED, CHECKED, SPLIT, FOLDS, SCORED, COUNTERFACTUAL])


def sql(body: str, *extra: str) -> str:
    """A statement over the stages above (unused stages cost nothing)."""
    return "WITH " + ", ".join([STAGES, *extra]) + "\n" + body.strip()


def r(expression: str, name: str, digits: int = 6) -> str:
    """Rounded output column; adding 0.0 turns a negative zero into a plain one."""
    return f'round({expression}, {digits}) + 0.0::DOUBLE AS "{name}"'
