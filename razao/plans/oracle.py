"""DuckDB SQL text of the registered queries (independent oracle).

Written against the same parquet tables, with the same view definitions as
``views``; computed columns carry the same aliases as the Spark results.
"""

from __future__ import annotations

from .views import CF_SQL


def _ratio_sql(num: str, den: str) -> str:
    return (f"CASE WHEN {num} IS NULL OR {den} IS NULL THEN 100.0 "
            f"WHEN abs({den}) = 0 THEN CASE WHEN abs({num}) = 0 THEN 100.0 ELSE 'inf'::DOUBLE END "
            f"ELSE abs({num})::DOUBLE / abs({den})::DOUBLE END")


def monthly_sql(source: str, by_category: bool, category_label: str = "Geral",
                where: str = "TRUE", rounded: bool = True) -> str:
    """Dense monthly summary over a CTE named ``cf``; returns CTE text ending
    in a CTE named ``monthly``."""
    k = "Categoria, " if by_category else ""
    kc = "c.Categoria, " if by_category else ""
    part = "Categoria, " if by_category else ""
    label = "Categoria" if by_category else f"'{category_label}' AS Categoria"
    keyfilter = "Categoria IS NOT NULL" if by_category else "TRUE"
    oir = _ratio_sql("Saidas", "Entradas")
    return f"""{source},
t AS (
  SELECT {k}CAST(year(Data) AS INTEGER) AS Ano, strftime(Data, '%Y-%m') AS Mes, Valor,
         CASE WHEN Valor >= 0 THEN 'In' ELSE 'Out' END AS Flow
  FROM cf WHERE {keyfilter} AND ({where})
),
s AS (
  SELECT {k}Ano, Mes,
         sum(CASE WHEN Flow = 'In' THEN Valor END) AS Entradas,
         count(CASE WHEN Flow = 'In' THEN Valor END) AS Entradas_N,
         sum(CASE WHEN Flow = 'Out' THEN Valor END) AS Saidas,
         count(CASE WHEN Flow = 'Out' THEN Valor END) AS Saidas_N
  FROM t WHERE Ano IS NOT NULL GROUP BY {k}Ano, Mes
),
sp AS (SELECT {k}min(Ano) AS lo, max(Ano) AS hi FROM s {"GROUP BY Categoria" if by_category else ""}),
yrs AS (SELECT {k}CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS Ano FROM sp),
cal AS (
  SELECT {k}Ano, printf('%04d-%02d', Ano, m) AS Mes
  FROM yrs, (SELECT unnest(generate_series(1, 12)) AS m) mm
),
d AS (
  SELECT {kc}c.Ano, c.Mes,
         coalesce(s.Entradas, 0) AS Entradas, coalesce(s.Entradas_N, 0) AS Entradas_N,
         coalesce(s.Saidas, 0) AS Saidas, coalesce(s.Saidas_N, 0) AS Saidas_N
  FROM cal c LEFT JOIN s ON {"c.Categoria = s.Categoria AND " if by_category else ""}c.Ano = s.Ano AND c.Mes = s.Mes
),
monthly AS (
  SELECT Ano, Mes, {label},
         Entradas, Entradas_N, Saidas, Saidas_N, Entradas + Saidas AS Fluxo,
         sum(Entradas) OVER w AS Entradas_Acum,
         sum(Saidas) OVER w AS Saidas_Acum,
         sum(Entradas + Saidas) OVER w AS Fluxo_Acum,
         {oir} AS OIR
  FROM d
  WINDOW w AS (PARTITION BY {part}Ano ORDER BY Mes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def finish_sql(cte: str, columns: list[str]) -> str:
    money = {"Entradas", "Saidas", "Fluxo", "Entradas_Acum", "Saidas_Acum", "Fluxo_Acum"}
    sel = []
    for c in columns:
        if c in money:
            sel.append(f"CAST({c} AS DOUBLE) AS {c}")
        elif c == "OIR":
            sel.append("round_even(OIR, 2) AS OIR")
        else:
            sel.append(c)
    return f"SELECT {', '.join(sel)} FROM {cte}"


MONTHLY_COLS = ["Ano", "Mes", "Categoria", "Entradas", "Entradas_N", "Saidas", "Saidas_N",
                "Fluxo", "Entradas_Acum", "Saidas_Acum", "Fluxo_Acum", "OIR"]
YEARLY_COLS = ["Ano", "Categoria", "Entradas", "Entradas_N", "Saidas", "Saidas_N", "Fluxo",
               "Entradas_Acum", "Saidas_Acum", "Fluxo_Acum", "OIR"]


def yearly_sql(monthly_cte_text: str) -> str:
    oir = _ratio_sql("Saidas", "Entradas")
    return f"""{monthly_cte_text},
ya AS (
  SELECT Categoria, Ano, sum(Entradas) AS Entradas, sum(Entradas_N) AS Entradas_N,
         sum(Saidas) AS Saidas, sum(Saidas_N) AS Saidas_N, sum(Fluxo) AS Fluxo
  FROM monthly GROUP BY Categoria, Ano
),
yearly AS (
  SELECT Ano, Categoria, Entradas, CAST(Entradas_N AS BIGINT) AS Entradas_N, Saidas,
         CAST(Saidas_N AS BIGINT) AS Saidas_N, Fluxo,
         sum(Entradas) OVER w AS Entradas_Acum, sum(Saidas) OVER w AS Saidas_Acum,
         sum(Fluxo) OVER w AS Fluxo_Acum, {oir} AS OIR
  FROM ya
  WINDOW w AS (PARTITION BY Categoria ORDER BY Ano ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def cashflow_sql() -> dict[str, str]:
    cf = "WITH " + CF_SQL.strip()
    return {
        "cf_monthly": monthly_sql(cf, False) + "\n" + finish_sql("monthly", MONTHLY_COLS),
        "cf_monthly_category": monthly_sql(cf, True) + "\n" + finish_sql("monthly", MONTHLY_COLS),
        "cf_yearly": yearly_sql(monthly_sql(cf, False)) + "\n" + finish_sql("yearly", YEARLY_COLS),
        "cf_yearly_category": yearly_sql(monthly_sql(cf, True)) + "\n" + finish_sql("yearly", YEARLY_COLS),
    }


# Order priorities of the driver's ``orders`` table: the category values of
# the ``cf`` view, fixed here because an SQL pivot needs its column list.
CF_CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
REPORT_YEAR = 1998


def report_sql(year: int = REPORT_YEAR) -> dict[str, str]:
    cf = "WITH " + CF_SQL.strip()
    y = f"""{cf},
y AS (
  SELECT strftime(Data, '%Y-%m') AS Mes, CASE WHEN Valor >= 0 THEN 'In' ELSE 'Out' END AS Flow,
         Categoria, Valor
  FROM cf WHERE Data >= TIMESTAMP '{year}-01-01' AND Data < TIMESTAMP '{year + 1}-01-01'
),
net AS (SELECT CAST(year(Data) AS INTEGER) AS Ano, sum(Valor) AS net FROM cf WHERE Data IS NOT NULL GROUP BY 1),
ob AS (
  SELECT Ano AS Year,
         coalesce(sum(net) OVER (ORDER BY Ano ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS Value
  FROM net
)"""
    cat_cols = [(f, c, f"{c}__{f}") for f in ("In", "Out") for c in CF_CATEGORIES]
    pivots = ",\n".join(
        f"sum(CASE WHEN Flow = '{f}' AND Categoria = '{c}' THEN Valor END) AS \"{n}\""
        for f, c, n in cat_cols)
    coal = ", ".join(f'coalesce(pm."{n}", 0) AS "{n}"' for _, _, n in cat_cols)
    outs = ", ".join(f'CAST("{n}" AS DOUBLE) AS "{n}"' for _, _, n in cat_cols)
    panel = f"""{y},
pm AS (
  SELECT Mes, sum(CASE WHEN Flow = 'In' THEN Valor END) AS Entradas,
         sum(CASE WHEN Flow = 'Out' THEN Valor END) AS Saidas,
         {pivots}
  FROM y GROUP BY Mes
),
months AS (SELECT {year} AS Ano, printf('%04d-%02d', {year}, m) AS Mes
           FROM (SELECT unnest(generate_series(1, 12)) AS m) g),
p AS (
  SELECT mo.Ano, mo.Mes, coalesce(pm.Entradas, 0) AS Entradas, coalesce(pm.Saidas, 0) AS Saidas, {coal}
  FROM months mo LEFT JOIN pm ON mo.Mes = pm.Mes
),
o AS (SELECT coalesce(max(Value), 0) AS open_v, count(*) > 0 AS found FROM ob WHERE Year = {year})
SELECT Ano, Mes, CAST(Entradas + Saidas AS DOUBLE) AS Fluxo, CAST(Entradas AS DOUBLE) AS Entradas,
       CAST(Saidas AS DOUBLE) AS Saidas, {outs},
       CAST(o.open_v + sum(Entradas + Saidas) OVER (ORDER BY Mes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS Saldo,
       o.found AS Saldo_Inicial_Found
FROM p, o"""
    summary = f"""{y},
pc AS (SELECT Flow, Categoria, sum(Valor) AS Total FROM y WHERE Categoria IS NOT NULL GROUP BY Flow, Categoria),
nf AS (SELECT Categoria, count(DISTINCT Flow) AS n FROM pc GROUP BY Categoria),
tot AS (SELECT coalesce(sum(CASE WHEN Flow = 'In' THEN Valor END), 0) AS E,
               coalesce(sum(CASE WHEN Flow = 'Out' THEN Valor END), 0) AS S FROM y),
r AS (
  SELECT 'ENTRADAS' AS Categoria, E AS Total FROM tot
  UNION ALL SELECT 'SAIDAS', S FROM tot
  UNION ALL SELECT CASE WHEN nf.n > 1 THEN pc.Categoria || '__' || pc.Flow ELSE pc.Categoria END, pc.Total
  FROM pc JOIN nf ON pc.Categoria = nf.Categoria
)
SELECT {year} AS Ano, Categoria, round_even(CAST(Total AS DOUBLE), 2) AS Total,
       round_even(CAST(Total * 100 AS BIGINT)::DOUBLE / 12, 0) / 100 AS Media,
       round_even(CASE WHEN Categoria = 'ENTRADAS' THEN 100.0 WHEN tot.E = 0 THEN 0.0
                       ELSE abs(CAST(Total AS DOUBLE)) / CAST(tot.E AS DOUBLE) * 100 END, 2) AS Pct_Entradas
FROM r, tot"""
    opening = f"""{y}
SELECT Year, CAST(Value AS DECIMAL(38,2)) AS Value FROM ob"""
    return {"report_panel": panel, "report_summary": summary, "report_opening": opening}



def _br_amount_sql(v: str) -> str:
    t = f"trim({v})"
    return (f"TRY_CAST(CASE WHEN contains({t}, ',') THEN replace(replace({t}, '.', ''), ',', '.') "
            f"ELSE {t} END AS DECIMAL(20,4))")


def _br_number_sql(v: str) -> str:
    return f"TRY_CAST(replace(replace(trim({v}), '.', ''), ',', '.') AS DECIMAL(20,4))"


def _cd_amount_sql(v: str) -> str:
    t = f"trim({v})"
    stripped = "regexp_replace(" + t + ", '[CD]', '', 'g')"
    return (f"(CASE WHEN ends_with({t}, 'D') THEN -1 ELSE 1 END * "
            f"abs({_br_number_sql(stripped)}))")


def statements_sql() -> dict[str, str]:
    from .views import T0_CD_SQL, T0_PP_SQL, T0_SQL

    def std(view: str, drop: str, amount: str, savings: bool = False) -> str:
        date = "try_strptime(trim(Data), '%d/%m/%Y')::DATE"
        if savings:
            cols = (f"{date} AS Data, CAST({amount} AS DOUBLE) AS Valor, "
                    "coalesce(\"Histórico\", '') AS Categoria, '' AS Descricao")
        else:
            cols = (f"{date} AS Data, CAST({amount} AS DOUBLE) AS Valor, '' AS Categoria, "
                    "'' AS Descricao, \"Lançamento\" AS Lancamento, coalesce(Detalhes, '') AS Detalhes, "
                    "\"N° documento\" AS Documento")
        return (f"SELECT {cols} FROM {view} WHERE NOT ({drop}) "
                f"AND {date} IS NOT NULL AND {amount} IS NOT NULL")

    def drops(view: str, drop: str, amount: str) -> str:
        date = "try_strptime(trim(Data), '%d/%m/%Y')"
        reason = (f"CASE WHEN {drop} THEN 'dropped' WHEN {date} IS NULL THEN 'bad_date' "
                  f"WHEN {amount} IS NULL THEN 'bad_amount' END")
        return (f"SELECT reason, Lancamento, count(*) AS n FROM (SELECT {reason} AS reason, "
                f"\"Lançamento\" AS Lancamento FROM {view}) q WHERE reason IS NOT NULL "
                "GROUP BY reason, Lancamento")

    cc_drop = "coalesce(\"Lançamento\" IN ('Saldo do dia', 'Saldo Anterior', 'S A L D O'), FALSE)"
    pj_drop = ("(coalesce(\"Lançamento\" IN ('BB Rende Fácil'), FALSE) "
               "OR coalesce(Valor IN ('0,00 C'), FALSE))")
    t0 = "WITH " + T0_SQL.strip() + "\n"
    cd = "WITH " + T0_CD_SQL.strip() + "\n"
    pp = "WITH " + T0_PP_SQL.strip() + "\n"
    cc_std = t0 + std("t0", cc_drop, _br_amount_sql("Valor"))
    # the mixed layouts: raw cells as written, and the cells as they are meant
    n = 'CAST("N° documento" AS BIGINT)'
    mixed = "WITH " + T0_SQL.strip() + f""",
tm AS (
  SELECT CASE WHEN {n} % 97 = 0 THEN '31/02/2024' ELSE Data END AS Data,
         CASE WHEN {n} % 97 = 0 THEN '31/02/2024'
              WHEN {n} % 7 = 0 THEN chr(9) || strftime(strptime(Data, '%d/%m/%Y'), '%-d/%-m/%Y') || chr(160)
              ELSE Data END AS Roh_Data,
         "Lançamento", "N° documento",
         CASE WHEN {n} % 5 = 0 THEN 'said "' || "Lançamento" || '", then' || chr(10) || 'left; ok'
              ELSE Detalhes END AS Detalhes,
         CASE WHEN {n} % 83 = 0 THEN 'R$ ?' ELSE Valor END AS Valor,
         CASE WHEN {n} % 83 = 0 THEN 'R$ ?' ELSE Valor || chr(9) END AS Roh_Valor
  FROM t0
)
"""
    return {
        "t0_standardize": cc_std,
        "t0_header_alias": cc_std,
        "t0_mixed_headers": mixed + std("tm", cc_drop, _br_amount_sql("Valor")),
        "t0_mixed_quarantine": mixed + (
            f"SELECT CASE WHEN {cc_drop} THEN 'dropped' WHEN try_strptime(Data, '%d/%m/%Y') IS NULL THEN 'bad_date' "
            "ELSE 'bad_amount' END AS reason, \"N° documento\" AS Documento, Roh_Data AS Data, Roh_Valor AS Valor FROM tm "
            f"WHERE {cc_drop} OR try_strptime(Data, '%d/%m/%Y') IS NULL OR {_br_amount_sql('Valor')} IS NULL"),
        "t0_drops": t0 + drops("t0", cc_drop, _br_amount_sql("Valor")),
        "pj_standardize": cd + std("t0_cd", pj_drop, _cd_amount_sql("Valor")),
        "pj_drops": cd + drops("t0_cd", pj_drop, _cd_amount_sql("Valor")),
        "pp_standardize": pp + std("t0_pp", "FALSE", _cd_amount_sql("Valor"), savings=True),
        "amount_br": t0 + ("SELECT \"N° documento\" AS Documento, Valor AS Texto, "
                           f"CAST({_br_amount_sql('Valor')} AS DOUBLE) AS Valor, "
                           f"CAST({_br_number_sql('Valor')} AS DOUBLE) AS Valor_Numero FROM t0"),
        "amount_cd": cd + ("SELECT \"N° documento\" AS Documento, Valor AS Texto, "
                           f"CAST({_cd_amount_sql('Valor')} AS DOUBLE) AS Valor FROM t0_cd"),
        "currency_text": (
            "SELECT c_custkey, c_acctbal, lpad(format('{:,.2f}', abs(c_acctbal)), "
            "CAST(greatest(11, length(format('{:,.2f}', abs(c_acctbal)))) AS INTEGER), ' ') || "
            "CASE WHEN c_acctbal < 0 THEN ' -' ELSE ' +' END AS Texto FROM customer"),
    }



AS_OF = "1998-06-30 00:00:00"
STAMP_AS_OF = "2025-01-01 00:00:00"
BUDGET_DATA_COLUMNS = ["Type", "Status", "Contract", "Name", "Value", "Date_Due", "Date_Exe", "Tags",
                       "Method", "Protocol", "File_Receipt", "File_Invoice", "File_NF"]
REC_COLUMNS = ["RecId", "RecTable", "RecTimestamp", "RecStatus"] + BUDGET_DATA_COLUMNS


def _txt(cols: list[str], alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return ", ".join(f"CAST({a}{c} AS VARCHAR) AS {c}" for c in cols)


def budget_sql() -> dict[str, str]:
    from .views import BUD_RAW_SQL, BUD_SQL

    bud = "WITH " + BUD_SQL.strip()
    signed = f"""{bud},
s AS (SELECT *, CASE WHEN Type = 'Revenue' THEN 1 ELSE -1 END AS Sign,
             CASE WHEN Type = 'Revenue' THEN 1 ELSE -1 END * Value AS Value_Signed FROM bud),
e AS (SELECT * FROM s WHERE Status IS DISTINCT FROM 'Prospected' AND Status IS DISTINCT FROM 'Cancelled'),
t AS (SELECT round(coalesce(sum(CASE WHEN Type = 'Revenue' THEN Value_Signed END), 0), 3) AS r,
             round(coalesce(sum(CASE WHEN Type = 'Expense' THEN Value_Signed END), 0), 3) AS x FROM e)
"""

    def by(key: str) -> str:
        return (signed + f"SELECT {key}, CAST(sum(Value_Signed) AS DOUBLE) AS Value_Signed FROM e "
                f"WHERE {key} IS NOT NULL GROUP BY {key}")

    raw = "WITH " + BUD_RAW_SQL.strip()
    tpl = f"""{bud},
tpl AS (SELECT RecId, CASE Status WHEN 'Executed' THEN 'W' WHEN 'Expected' THEN 'MS'
                   WHEN 'Prospected' THEN 'QS' WHEN 'Cancelled' THEN 'ME' ELSE 'YS' END AS Freq, Value FROM bud),
days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1999-01-01', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT RecId, Freq, CAST(Value AS DOUBLE) AS Value, d AS Date_Due FROM tpl, days
WHERE Freq = 'D' OR (Freq = 'W' AND dayofweek(d) = 0) OR (Freq = 'MS' AND day(d) = 1)
   OR (Freq = 'QS' AND day(d) = 1 AND month(d) IN (1, 4, 7, 10)) OR (Freq = 'YS' AND dayofyear(d) = 1)
   OR (Freq = 'ME' AND d = last_day(d))"""
    cust = """
cust AS (
  SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'Revenue' ELSE 'Expense' END AS Type, 'Expected' AS Status,
         'C' || CAST(c_custkey % 20 AS VARCHAR) AS Contract, c_name AS Name,
         CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS Value, c_mktsegment AS Tags
  FROM customer
)"""
    bud_txt = f"SELECT {_txt(REC_COLUMNS)} FROM bud"
    new_cols = []
    for c in BUDGET_DATA_COLUMNS:
        new_cols.append(f"CAST({c} AS VARCHAR) AS {c}" if c in ("Type", "Status", "Contract", "Name", "Value", "Tags")
                        else f"'' AS {c}")
    insert = f"""{bud},{cust}
{bud_txt}
UNION ALL
SELECT printf('Rec%04d', (SELECT max(CAST(substr(RecId, 4) AS BIGINT)) FROM bud) + row_number() OVER (ORDER BY c_custkey)) AS RecId,
       'Budget' AS RecTable, '{STAMP_AS_OF}' AS RecTimestamp, 'On' AS RecStatus, {', '.join(new_cols)}
FROM cust"""
    edit_sel = []
    for c in REC_COLUMNS:
        if c == "RecId":
            edit_sel.append("b.RecId")
        elif c == "RecTimestamp":
            edit_sel.append(f"CASE WHEN e.RecId IS NOT NULL THEN '{STAMP_AS_OF}' ELSE b.RecTimestamp END AS RecTimestamp")
        elif c == "Status":
            edit_sel.append("CASE WHEN e.RecId IS NOT NULL THEN 'Executed' ELSE CAST(b.Status AS VARCHAR) END AS Status")
        elif c == "Date_Exe":
            edit_sel.append("CASE WHEN e.RecId IS NOT NULL THEN e.dexe ELSE CAST(b.Date_Exe AS VARCHAR) END AS Date_Exe")
        else:
            edit_sel.append(f"CAST(b.{c} AS VARCHAR) AS {c}")
    edit = f"""{bud},
ed AS (SELECT printf('Rec%04d', o_orderkey + 1) AS RecId,
              CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS dexe
       FROM orders WHERE o_orderpriority = '2-HIGH')
SELECT {', '.join(edit_sel)} FROM bud b LEFT JOIN ed e ON b.RecId = e.RecId"""
    arch_sel = []
    for c in REC_COLUMNS:
        if c == "RecId":
            arch_sel.append("b.RecId")
        elif c == "RecTimestamp":
            arch_sel.append(f"CASE WHEN a.RecId IS NOT NULL THEN '{STAMP_AS_OF}' ELSE b.RecTimestamp END AS RecTimestamp")
        elif c == "RecStatus":
            arch_sel.append("CASE WHEN a.RecId IS NOT NULL THEN 'Off' ELSE b.RecStatus END AS RecStatus")
        else:
            arch_sel.append(f"CAST(b.{c} AS VARCHAR) AS {c}")
    archive = f"""{bud},
ar AS (SELECT printf('Rec%04d', o_orderkey + 1) AS RecId FROM orders
       WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01')
SELECT {', '.join(arch_sel)} FROM bud b LEFT JOIN ar a ON b.RecId = a.RecId"""
    conform_cols = ", ".join(
        f"CAST({c} AS VARCHAR) AS {c}" for c in BUDGET_DATA_COLUMNS)
    conform = f"""{raw}
SELECT printf('Rec%04d', row_number() OVER (ORDER BY o_orderkey)) AS RecId, 'Budget' AS RecTable,
       '{STAMP_AS_OF}' AS RecTimestamp, 'On' AS RecStatus, {conform_cols}
FROM bud_raw"""
    first_cols = []
    for c in BUDGET_DATA_COLUMNS:
        first_cols.append(f"CAST({c} AS VARCHAR) AS {c}" if c in ("Name", "Value") else f"'' AS {c}")
    first = f"""WITH li AS (
  SELECT printf('Rec%04d', l_orderkey + 1) AS RecId, 'Line ' || CAST(l_linenumber AS VARCHAR) AS Name,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS Value,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
  FROM lineitem
)
SELECT RecId, 'Budget' AS RecTable, '{STAMP_AS_OF}' AS RecTimestamp, 'On' AS RecStatus, {', '.join(first_cols)}
FROM li WHERE rn = 1"""
    vertical = f"""{bud}
SELECT _id AS RecId, Field, Value
FROM (SELECT RecId AS _id, {_txt(REC_COLUMNS)} FROM bud)
UNPIVOT INCLUDE NULLS (Value FOR Field IN ({', '.join(REC_COLUMNS)}))"""
    secs = (f"(epoch(TIMESTAMP '{STAMP_AS_OF}') - epoch(CAST(Date_Due AS TIMESTAMP)))")
    days = f"CAST(floor({secs} / 86400) AS BIGINT)"
    running = f"""{bud},
r AS (SELECT RecId, Date_Due, CAST({secs} AS BIGINT) AS Seconds_Total, {days} AS dd FROM bud),
r2 AS (SELECT *, CAST(floor(dd / 365) AS BIGINT) AS Years, Seconds_Total - dd * 86400 AS rest FROM r),
r3 AS (SELECT *, dd - Years * 365 AS rdays FROM r2)
SELECT RecId, Seconds_Total, Years, CAST(floor(rdays / 30) AS BIGINT) AS Months,
       CAST(rdays - floor(rdays / 30) * 30 AS BIGINT) AS Days,
       CAST(floor(rest / 3600) AS BIGINT) AS Hours, CAST(floor((rest % 3600) / 60) AS BIGINT) AS Minutes,
       CAST(rest % 60 AS BIGINT) AS Seconds,
       CAST(trunc(datediff('day', CAST(Date_Due AS DATE), DATE '{STAMP_AS_OF[:10]}') / 365) AS BIGINT) AS Age
FROM r3"""
    text = f"""{bud},
r AS (SELECT RecId, CAST(floor((epoch(TIMESTAMP '{STAMP_AS_OF}') - epoch(CAST(Date_Due AS TIMESTAMP))) / 86400) AS BIGINT) AS dd FROM bud),
r2 AS (SELECT RecId, dd, CAST(floor(dd / 365) AS BIGINT) AS y FROM r)
SELECT RecId, 'yr: ' || y || ', mth: ' || CAST(floor((dd - y * 365) / 30) AS BIGINT) AS Running,
       'Expected years: ' || y || ', d: ' || CAST((dd - y * 365) - floor((dd - y * 365) / 30) * 30 AS BIGINT) AS Custom
FROM r2"""
    return {
        "budget_totals": signed + ("SELECT CAST(r AS DOUBLE) AS Total_Revenue, CAST(x AS DOUBLE) AS Total_Expenses, "
                                   "CAST(r + x AS DOUBLE) AS Total_Net, (r + x) <= 0 AS Ascending FROM t"),
        "budget_by_status": by("Status"),
        "budget_by_contract": by("Contract"),
        "budget_by_tags": by("Tags"),
        "budget_tag_tokens": signed + ("SELECT token, count(*) AS count FROM (SELECT unnest(string_split_regex("
                                       "trim(Tags), '\\s+')) AS token FROM e) q WHERE token <> '' GROUP BY token"),
        "budget_by_type": signed + ("SELECT 'Total_Expenses' AS measure, CAST(x AS DOUBLE) AS value FROM t "
                                    "UNION ALL SELECT 'Total_Revenue', CAST(r AS DOUBLE) FROM t "
                                    "UNION ALL SELECT 'Total_Net', CAST(r + x AS DOUBLE) FROM t"),
        "budget_auto_status": bud + (f"\nSELECT RecId, Status, Method, Date_Due, CASE WHEN Method = 'Automatic' AND "
                                     f"Status = 'Expected' AND CAST(Date_Due AS TIMESTAMP) <= TIMESTAMP '{AS_OF}' "
                                     "THEN 'Executed' ELSE Status END AS Status_Updated FROM bud"),
        "budget_recurrence": tpl,
        "budget_formulas": signed + (f"SELECT RecId, Sign, CAST(Value_Signed AS DOUBLE) AS Value_Signed, "
                                     f"CASE WHEN Method = 'Automatic' AND Status = 'Expected' AND "
                                     f"CAST(Date_Due AS TIMESTAMP) <= TIMESTAMP '{AS_OF}' THEN 'Executed' "
                                     "ELSE Status END AS Status FROM s"),
        "rec_conform": conform,
        "rec_insert": insert,
        "rec_edit": edit,
        "rec_edit_repeated": bud + (
            ", e AS (SELECT printf('Rec%04d', l_orderkey + 1) AS id, max(l_linenumber) AS n FROM lineitem GROUP BY 1)\n"
            f"SELECT RecId, CASE WHEN e.id IS NULL THEN RecTimestamp ELSE '{STAMP_AS_OF}' END AS RecTimestamp, "
            "CASE WHEN e.id IS NULL THEN Protocol ELSE CAST(e.n AS VARCHAR) END AS Protocol "
            "FROM bud LEFT JOIN e ON e.id = bud.RecId"),
        "rec_unmatched": bud + ("\nSELECT RecId FROM (SELECT printf('Rec%04d', c_custkey * 1000 + 1) AS RecId FROM customer) c "
                                "WHERE RecId NOT IN (SELECT RecId FROM bud)"),
        "budget_frequency_quarantine": bud + (
            "\nSELECT RecId, Freq, 'bad_frequency' AS reason FROM (SELECT RecId, "
            "CASE WHEN Status = 'Expected' THEN '2W' ELSE Status END AS Freq FROM bud) f "
            "WHERE Freq IS NULL OR Freq <> '2W'"),
        "rec_archive": archive,
        "rec_next_id": bud + ("\nSELECT coalesce(max(CAST(substr(RecId, 4) AS BIGINT)), 0) AS last, "
                              "printf('Rec%04d', coalesce(max(CAST(substr(RecId, 4) AS BIGINT)), 0) + 1) AS next FROM bud"),
        "rec_vertical": vertical,
        "rec_active": bud + "\nSELECT * FROM bud WHERE RecStatus = 'On'",
        "rec_lookup": bud + ("\nSELECT * FROM bud WHERE RecId IN (SELECT printf('Rec%04d', l_orderkey + 1) "
                             "FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')"),
        "rec_first_dup": first,
        "running_time": running,
        "interval_text": text,
    }



def catalog_sql() -> dict[str, str]:
    from .views import CAT_SQL

    alias = "CASE WHEN length({n}) >= 2 THEN substr({n}, 1, 1) || substr({n}, length({n}), 1) ELSE {n} END"
    latest = f"""WITH {CAT_SQL.strip()},
latest AS (
  SELECT name, seq, source, description, size, Date, {alias.format(n='name')} AS alias
  FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM cat) q WHERE rn = 1
)
"""
    renamed = f"""WITH {CAT_SQL.strip()},
l0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM cat) q WHERE rn = 1),
rn AS (SELECT name AS old_name, regexp_replace(name, '^User_', 'Member_') AS new_name FROM l0 WHERE source = 'purchase'),
keyed AS (SELECT coalesce(rn.new_name, c.name) AS name, seq, source, description, size, Date
          FROM cat c LEFT JOIN rn ON c.name = rn.old_name)
SELECT name, seq, source, description, size, Date, {alias.format(n='name')} AS alias
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS r FROM keyed) q WHERE r = 1"""
    fields = ["seq", "source", "description", "size", "Date", "alias"]
    txt = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in fields)
    inss_rows = "(1, NULL, 1518.00, 0.075), (2, 1518.00, 2793.88, 0.09), (3, 2793.88, 4190.83, 0.12), (4, 4190.83, 8157.41, 0.14)"
    irrf_rows = ("(1, 2428.81, NULL, 2826.65, 0.075, 182.16), (2, 2826.66, 2826.65, 3751.05, 0.15, 394.16), "
                 "(3, 3751.06, 3751.05, 4664.68, 0.225, 675.49), (4, 4664.68, 4664.68, NULL, 0.275, 908.73)")
    sal = "sal AS (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS amount FROM customer)"
    return {
        "catalog_latest": latest + "SELECT * FROM latest",
        "catalog_remove": latest + ("SELECT * FROM latest WHERE name NOT IN (SELECT 'User_' || CAST(user_id AS VARCHAR) "
                                    "FROM events WHERE event_type = 'signup' AND value > 300)"),
        "catalog_refresh": renamed,
        "catalog_size": latest + "SELECT count(*) AS size FROM latest",
        "catalog_metadata_rows": latest + (f"SELECT name, field, value FROM (SELECT name, {txt} FROM latest) "
                                           f"UNPIVOT INCLUDE NULLS (value FOR field IN ({', '.join(fields)}))"),
        "catalog_alias": (f"SELECT name, {alias.format(n='name')} AS alias FROM "
                          "(SELECT DISTINCT CAST(user_id AS VARCHAR) AS name FROM events) q"),
        "dict_table": ("SELECT CAST(event_id AS VARCHAR) AS key, CAST(user_id AS VARCHAR) AS \"user\", "
                       "event_type AS type FROM events"),
        "catalog_preview": latest + ("SELECT *, 'head' AS part FROM (SELECT * FROM latest ORDER BY name ASC LIMIT 5) h "
                                     "UNION ALL SELECT *, 'tail' AS part FROM (SELECT * FROM latest ORDER BY name DESC LIMIT 5) t"),
        "tax_inss": (f"WITH {sal}, t AS (SELECT * FROM (VALUES {inss_rows}) v(bracket, lo_excl, hi, rate))\n"
                     "SELECT c_custkey, CAST(amount AS DOUBLE) AS amount, t.bracket AS inss_bracket, "
                     "CAST(t.rate AS DOUBLE) AS inss_rate FROM sal LEFT JOIN t ON "
                     "(t.lo_excl IS NULL OR amount > t.lo_excl) AND amount <= t.hi"),
        "tax_irrf": (f"WITH {sal}, t AS (SELECT bracket, CAST(lo AS DECIMAL(18,2)) lo, CAST(lo_excl AS DECIMAL(18,2)) lo_excl, "
                     "CAST(hi AS DECIMAL(18,2)) hi, CAST(rate AS DECIMAL(6,4)) rate, CAST(ded AS DECIMAL(18,2)) ded "
                     f"FROM (VALUES {irrf_rows}) v(bracket, lo, lo_excl, hi, rate, ded))\n"
                     "SELECT c_custkey, CAST(amount AS DOUBLE) AS amount, t.bracket AS irrf_bracket, "
                     "CAST(t.rate AS DOUBLE) AS irrf_rate, CAST(t.ded AS DOUBLE) AS irrf_deduction, "
                     "CAST(amount * t.rate - t.ded AS DOUBLE) AS irrf_tax FROM sal LEFT JOIN t ON "
                     "(CASE WHEN t.lo_excl IS NULL THEN amount >= t.lo ELSE amount > t.lo_excl END) "
                     "AND (t.hi IS NULL OR amount <= t.hi)"),
    }



def invoices_sql() -> dict[str, str]:
    from .views import NFSE_EXPECTED_SQL

    base = "WITH " + NFSE_EXPECTED_SQL.strip() + "\n"
    taker = ("coalesce(tomador_cnpj || ' (CNPJ) -- ' || tomador_nome, tomador_nif || ' (NIF) -- ' || tomador_nome, "
             "tomador_nome)")
    name = "'NFSe_' || split_part(regexp_extract(file_data, '([^/]+)$', 1), '.', 1)"
    return {
        "nfse_extract": base + "SELECT * FROM nfse",
        "nfse_party_label": base + (f"SELECT file_data, prestador_cnpj || ' -- ' || prestador_nome AS Prestador, "
                                    f"{taker} AS Tomador FROM nfse"),
        "nfse_catalog": base + (f"SELECT {name} AS name, {name} AS alias, CAST(NULL AS BIGINT) AS size, "
                                "CAST(NULL AS VARCHAR) AS color, CAST(NULL AS VARCHAR) AS source, "
                                "CAST(NULL AS VARCHAR) AS description, file_data, Date, "
                                f"prestador_cnpj || ' -- ' || prestador_nome AS Prestador, {taker} AS Tomador, "
                                "ValorServico, p_tributo_SN AS PTributoSN, servico_codigo AS ServicoID, "
                                "CAST(NULL AS VARCHAR) AS Projeto FROM nfse"),
    }



def cdb_sql() -> dict[str, str]:
    from .views import CDB_EXPECTED_SQL

    base = "WITH " + CDB_EXPECTED_SQL.strip() + "\n"
    return {
        "cdb_extrato": base + ("SELECT file, account, make_date(year, month, day) AS Data, CAST(cap AS DOUBLE) AS Valor, "
                               "CASE WHEN juros_row THEN 'Juros' ELSE 'Aplicacao' END AS Categoria, '' AS Descricao FROM cdb"),
        "cdb_saldos": base + ("SELECT file, account, make_date(year, month, day) AS Data, CAST(cap AS DOUBLE) AS Capital_Inicial, "
                              "CAST(juros AS DOUBLE) AS Juros, CAST(ir AS DOUBLE) AS IR_Projetado, "
                              "CAST(cap + juros - ir AS DOUBLE) AS Capital_Projetado FROM cdb"),
        "cdb_depositos": base + ("SELECT file, account, CAST(s_suppkey AS VARCHAR) AS Deposito, "
                                 "make_date(year, month, day) AS Data_Aplicacao, CAST(cap AS DOUBLE) AS Capital, "
                                 "CAST(cap + juros AS DOUBLE) AS Saldo, (s_suppkey % 90 + 10) / 100.0 AS Taxa, "
                                 "make_date(year + 2, month, day) AS Data_Vencimento FROM cdb"),
        "cdb_rendimentos": base + ("SELECT file, account, make_date(year, month, day) AS Data, "
                                   "CAST(s_suppkey AS VARCHAR) AS Deposito, CAST(juros AS DOUBLE) AS Rendimento_Bruto FROM cdb"),
    }



def notes_sql() -> dict[str, str]:
    from ..functions.text import INLINE_WS_CLASS, WS_CLASS
    from .views import NOTES_SQL

    base = "WITH " + NOTES_SQL.strip() + "\n"
    strip = f"regexp_replace(x, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"
    body = f"list_transform(string_split(doc_text, chr(10)), lambda x: {strip})"
    squeeze = f"'(?m)^({INLINE_WS_CLASS}*\\n)(?:{INLINE_WS_CLASS}*\\n)+'"
    i = "CAST(doc_id AS VARCHAR)"
    fm = (f"SELECT doc_id, 'title' AS key, ['Doc ' || {i}] AS value, FALSE AS is_list, 0 AS key_pos FROM notes "
          "UNION ALL SELECT doc_id, 'lang', [lang], FALSE, 1 FROM notes "
          "UNION ALL SELECT doc_id, 'source', [source], FALSE, 2 FROM notes "
          "UNION ALL SELECT doc_id, 'tags', [lang, source], TRUE, 3 FROM notes "
          f"UNION ALL SELECT doc_id, 'related', ['[[doc ' || CAST(doc_id + 1 AS VARCHAR) || ']]', source], TRUE, 4 FROM notes "
          "UNION ALL SELECT doc_id, 'empty', CAST(NULL AS VARCHAR[]), TRUE, 7 FROM notes")
    rendered = (f"'---' || chr(10) || 'title: Doc ' || {i} || chr(10) || 'lang: ' || lang || chr(10) || "
                "'source: ' || source || chr(10) || 'tags:' || chr(10) || ' - ' || lang || chr(10) || ' - ' || source || "
                f"chr(10) || 'related:' || chr(10) || ' - [[doc ' || CAST(doc_id + 1 AS VARCHAR) || ']]' || chr(10) || "
                "' - ' || source || chr(10) || 'empty: ' || chr(10) || '---' || chr(10) || "
                "lang || ' note #' || lang || chr(10) || chr(10) || '---' || chr(10) || chr(10) || "
                f"array_to_string(list_concat(['', '', ''], {body}), chr(10)) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || "
                f"'tail [[ref ' || {i} || ']]' || chr(10) || chr(10) || '---' || chr(10) || chr(10)")
    return {
        "note_frontmatter": base + fm,
        "note_sections": base + (f"SELECT doc_id, [lang || ' note #' || lang] AS Head, "
                                 f"list_concat(['', '', ''], {body}) AS Body, "
                                 f"['tail [[ref ' || {i} || ']]'] AS Tail FROM notes"),
        "note_tags": base + ("SELECT doc_id, CASE WHEN len(t) > 0 THEN t END AS tags FROM "
                             "(SELECT doc_id, regexp_extract_all(text, '#[\\p{L}\\p{N}_]+') AS t FROM notes) q"),
        "note_links": base + ("SELECT doc_id, CASE WHEN len(t) > 0 THEN t END AS links FROM "
                              "(SELECT doc_id, regexp_extract_all(text, '\\[\\[.*?\\]\\]') AS t FROM notes) q"),
        "note_squeeze": base + f"SELECT doc_id, regexp_replace(text, {squeeze}, '\\1', 'g') AS text FROM notes",
        "note_render": base + f"SELECT doc_id, regexp_replace({rendered}, {squeeze}, '\\1', 'g') AS text FROM notes",
    }



def files_io_sql() -> dict[str, str]:
    from .views import BUD_SQL, CF_SQL, T0_PP_SQL, T0_SQL

    files = """WITH f0 AS (
  SELECT *, ['bb-cc', 'bb-ccpj', 'bb-pp'][CAST(user_id % 3 AS INTEGER) + 1] AS account_type FROM events
),
f AS (
  SELECT '/extratos/' || strftime(ts, '%Y') || '/' ||
         concat_ws('_', 'EXTRATO', upper(split_part(account_type, '-', 1)),
                   upper(split_part(account_type, '-', 2)) || CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d'))
         || '_T0.csv' AS path, account_type, event_type
  FROM f0
)
"""
    t1 = "regexp_replace(path, '_T0(\\.[^./]+)$', '_T1\\1')"
    base = "regexp_extract({p}, '([^/]+)$', 1)"
    reg = ("reg AS (SELECT * FROM (VALUES ('bb-cc', 'Banco do Brasil', 'Conta Corrente PF'), "
           "('bb-ccpj', 'Banco do Brasil', 'Conta Corrente PJ'), ('bb-pp', 'Banco do Brasil', 'Conta Poupança PF'), "
           "('bb-cdb', 'Banco do Brasil', 'Aplicação CDB')) v(account_type, bank, account))")
    tier = (files + f", {reg},\nd AS (SELECT DISTINCT path, account_type FROM f),\n"
            "x AS (SELECT d.*, reg.bank, reg.account, CAST(regexp_extract(path, '/(\\d{4})/[^/]+$', 1) AS INTEGER) AS year, "
            "upper(split_part(d.account_type, '-', 1)) AS bank_code, upper(split_part(d.account_type, '-', 2)) AS account_code "
            "FROM d LEFT JOIN reg ON d.account_type = reg.account_type)\n"
            f"SELECT path, year, {base.format(p=t1)} AS t1_file, bank_code, account_code, bank AS bank_name, "
            "account AS account_name, "
            "concat_ws('_', 'CAIXA', bank_code, account_code, CAST(year AS VARCHAR)) || '_DIARIO.csv' AS daily_file, "
            "concat_ws('_', 'CAIXA', bank_code, account_code, CAST(year AS VARCHAR)) || '_MENSAL.csv' AS monthly_file, "
            "concat_ws('_', 'CAIXA', bank_code, account_code, CAST(year AS VARCHAR)) || '_ANUAL.csv' AS yearly_file FROM x")
    unproc = (files + f"SELECT DISTINCT path FROM f WHERE {base.format(p=t1)} NOT IN "
              f"(SELECT {base.format(p=t1)} FROM f WHERE event_type = 'purchase')")
    status = """WITH refs AS (
  SELECT printf('Rec%04d', o_orderkey + 1) AS RecId, 'File_Invoice' AS field,
         printf('/invoices/NFSe_%06d.xml', o_orderkey) AS file FROM orders
  UNION ALL
  SELECT printf('Rec%04d', o_orderkey + 1), 'File_Receipt', printf('/receipts/R_%06d.pdf', o_orderkey)
  FROM orders WHERE o_orderstatus = 'F'
),
inv AS (SELECT DISTINCT printf('/invoices/NFSe_%06d.xml', o_orderkey) AS path
        FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT RecId, field, file, CASE WHEN file IN (SELECT path FROM inv) THEN 'ok' ELSE 'missing' END AS status
FROM refs"""
    inventory = ("SELECT regexp_extract(filename, '([^/]+)$', 1) AS file, size AS length, "
                 "CAST(size AS DOUBLE) / 1048576 AS size_mb FROM read_blob('/root/testdata/sf0.01/*.parquet')")
    typed = ("SELECT l_extendedprice AS p, l_discount AS rm, l_tax AS tas FROM lineitem "
             "WHERE l_returnflag <> 'R' AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL")
    std = statements_sql()
    cc_std = std["t0_standardize"].split("\nSELECT", 1)
    pp_std = std["pp_standardize"].split("\nSELECT", 1)
    multi = (f"WITH {T0_SQL.strip()}, {T0_PP_SQL.strip()},\n"
             f"cc AS (SELECT{cc_std[1]}),\npp AS (SELECT{pp_std[1]})\n"
             "SELECT CAST(Data AS VARCHAR) AS Data, CAST(CAST(Valor AS DECIMAL(30,10)) AS VARCHAR) AS Valor, "
             "nullif(Categoria, '') AS Categoria, nullif(Descricao, '') AS Descricao, nullif(Lancamento, '') AS Lancamento, "
             "nullif(Detalhes, '') AS Detalhes, nullif(Documento, '') AS Documento, CAST(year(Data) AS INTEGER) AS Ano FROM cc "
             "UNION ALL SELECT CAST(Data AS VARCHAR), CAST(CAST(Valor AS DECIMAL(30,10)) AS VARCHAR), nullif(Categoria, ''), "
             "nullif(Descricao, ''), NULL, NULL, NULL, NULL FROM pp")
    rec_cols = ["RecId", "RecTable", "RecTimestamp", "RecStatus"] + BUDGET_DATA_COLUMNS
    roundtrip = (f"WITH {BUD_SQL.strip()}\nSELECT "
                 + ", ".join(f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in rec_cols)
                 + " FROM bud WHERE RecStatus = 'On'")
    kv = ("SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'system') AS system, "
          "max_by(text, turn) FILTER (WHERE role = 'user') AS \"user\", "
          "max_by(text, turn) FILTER (WHERE role = 'assistant') AS assistant "
          "FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id")
    consolidated = (f"WITH {CF_SQL.strip()}\nSELECT Data, Categoria, CAST(Valor AS DOUBLE) AS Valor, Descricao, "
                    "CAST(year(Data) AS INTEGER) AS Ano FROM cf")
    return {
        "tier_names": tier,
        "files_unprocessed": unproc,
        "file_status": status,
        "file_inventory": inventory,
        "typed_scan": typed,
        "multi_file_scan": multi,
        "roundtrip_export": roundtrip,
        "kv_pivot": kv,
        "cf_consolidated": consolidated,
        "t0_incremental": std["t0_standardize"],
    }



def roundtrip_sql() -> dict[str, str]:
    from .views import CF_SQL

    cf = cashflow_sql()
    return {
        "cf_file_pipeline": cf["cf_monthly"],
        "t0_csv_scan": statements_sql()["t0_standardize"],
        "report_panel_files": report_sql()["report_panel"],
        "dataset_bootfile": (f"WITH {CF_SQL.strip()}\nSELECT 'CashFlow' AS id, 'CashFlow' AS name, 'Cw' AS alias, "
                             "CAST(count(*) AS VARCHAR) AS size, strftime(min(Data), '%Y-%m-%d %H:%M:%S') AS start, "
                             "strftime(max(Data), '%Y-%m-%d %H:%M:%S') AS \"end\" FROM cf"),
    }



def consolidated_yearly_sql() -> dict[str, str]:
    cf = "WITH " + CF_SQL.strip()
    text = yearly_sql(monthly_sql(cf, False)) + "\n" + finish_sql("yearly", YEARLY_COLS)
    # per-year outputs: the cumulative columns equal the year's own values
    text = text.replace("sum(Entradas) OVER w AS Entradas_Acum, sum(Saidas) OVER w AS Saidas_Acum,\n"
                        "         sum(Fluxo) OVER w AS Fluxo_Acum",
                        "Entradas AS Entradas_Acum, Saidas AS Saidas_Acum,\n         Fluxo AS Fluxo_Acum")
    return {"cf_consolidated_yearly": text}



def record_fields_sql() -> dict[str, str]:
    from .views import BUD_SQL

    cols = ["RecId", "RecTable", "RecTimestamp", "RecStatus"] + BUDGET_DATA_COLUMNS
    txt = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
    return {"rec_export_fields": f"""WITH {BUD_SQL.strip()},
sel AS (SELECT * FROM bud WHERE RecId IN (SELECT printf('Rec%04d', l_orderkey + 1) FROM lineitem
                                          WHERE l_returnflag = 'R' AND l_linestatus = 'F'))
SELECT _id AS RecId, Field, nullif(Value, '') AS Value
FROM (SELECT RecId AS _id, {txt} FROM sel)
UNPIVOT INCLUDE NULLS (Value FOR Field IN ({', '.join(cols)}))"""}


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(cashflow_sql())
    out.update(report_sql())
    out.update(statements_sql())
    out.update(budget_sql())
    out.update(catalog_sql())
    out.update(invoices_sql())
    out.update(cdb_sql())
    out.update(notes_sql())
    out.update(files_io_sql())
    out.update(roundtrip_sql())
    out.update(consolidated_yearly_sql())
    out.update(record_fields_sql())
    return out
