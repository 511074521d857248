"""The registered queries as plain SQL for an independent engine."""

from __future__ import annotations

import re

KEYS = 'id, name, day_date, l_orderkey, l_linenumber, l_partkey'
TIES = 'l_orderkey, l_linenumber, l_partkey'
CUT = "date '2000-06-01'"

# Common table expressions by name; each may use the ones before it.
CTES = {
    "gas_raw": """
        select l_suppkey as id,
               1000 * (s_nationkey + 1) + l_suppkey % 1000 as cp,
               case when l_linestatus = 'O' then 'R' else 'A' end as pop,
               4100000 + (l_suppkey * 7919) % 1000000 as lat,
               -500000 + (l_suppkey * 104729) % 1300000 as "long",
               case when l_orderkey % 97 = 0 then 'n/a'
                    else strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') end as "date",
               case p_type when 'STANDARD' then 1 when 'SMALL' then 2 when 'LARGE' then 3
                           when 'MEDIUM' then 4 when 'ECONOMY' then 5 else 6 end as "type",
               p_type as name,
               cast(round(l_extendedprice * 100, 0) as double) as prix,
               l_orderkey, l_linenumber, l_partkey
        from lineitem
        join part on l_partkey = p_partkey
        join supplier on l_suppkey = s_suppkey""",
    "parsed": """
        select * replace (lat / 100000.0::double as lat, "long" / 100000.0::double as "long"),
               try_strptime("date", '%Y-%m-%d %H:%M:%S') as date_parsed
        from gas_raw""",
    "cleaned": """
        select *, cast(date_parsed as date) as day_date,
               cast(year(date_parsed) as integer) as year,
               cast(month(date_parsed) as integer) as month,
               cast(weekofyear(date_parsed) as integer) as week
        from parsed where date_parsed is not null""",
    "rare": """
        select name, count(*) as n_rows from cleaned where name is not null
        group by name order by n_rows, name limit 2""",
    "kept": """
        select * from cleaned
        where name is not null and name not in (select name from rare)""",
    "national": """
        select day_date, name, avg(prix) as avg_day_price_france
        from kept group by day_date, name""",
    "indexed": """
        select kept.*, avg_day_price_france,
               round(100 * ((prix - avg_day_price_france) / avg_day_price_france + 1), 2)
                   as price_index,
               (year - 1995) * 52 + week as week_index
        from kept left join national using (day_date, name)""",
    "weekly": """
        select (year - 1995) * 52 + week as week_index, name, avg(prix) as avg_weekly_price
        from kept group by 1, 2""",
    "dept_avg": """
        select substring(lpad(cast(cp as varchar), 5, '0'), 1, 2) as dept, name,
               sum(cast(round(price_index * 100) as bigint)) / cast(count(*) as double) / 100
                   as avg_index
        from indexed group by 1, 2""",
    "coord_avg": """
        select name, lat, "long",
               sum(cast(round(price_index * 100) as bigint)) / cast(count(*) as double) / 100
                   as avg_index
        from indexed group by all""",
    "past": f"""
        select *, lag(prix, 1) over w as price_lag_1, lag(prix, 2) over w as price_lag_2,
               lag(prix, 3) over w as price_lag_3, lag(prix, 7) over w as price_lag_7,
               avg(prix) over (w rows between 7 preceding and 1 preceding) as rolling_avg_7
        from indexed
        window w as (partition by id, name order by day_date, {TIES})""",
    "forecast": f"""
        select {KEYS}, prix, month, cp, price_lag_1, price_lag_7, rolling_avg_7, price_lag_1 as prediction
        from past where price_lag_7 is not null""",
}

_ALL = list(CTES)


def _needed(text: str) -> set[str]:
    found = {c for c in _ALL if c in re.split(r"[(),\s]+", text)}
    return found.union(*[_needed(CTES[c]) for c in found]) if found else found


def _with_ctes(select: str) -> str:
    needed = _needed(select)
    parts = [f"{c} as ({CTES[c]})" for c in _ALL if c in needed]
    return "with " + ",\n".join(parts) + "\n" + select if parts else select


SELECTS = {
    "src_csv_gz": """
        select id, cast(cp as varchar) as cp, pop, cast(lat as double) as lat,
               cast("long" as double) as "long", "date", "type", name, prix
        from gas_raw""",
    "src_multi_year": "select year, count(*) as n_rows from cleaned group by year",
    "sink_parquet": f'select {KEYS}, prix, lat, "long" from cleaned',
    "stage_materialize": f"select {KEYS}, prix from kept",
    "sql_year_avg": "select year, name, avg(prix) as avg_price from cleaned group by year, name",
    "clean_prices": "select * from cleaned",
    "drop_rare_types": "select name, count(*) as n_rows from kept group by name",
    "filter_type": f"select {KEYS}, prix from cleaned where name = 'MEDIUM'",
    "filter_year_type": f"""
        select {KEYS}, year, prix from cleaned
        where year in (1997, 1998) and name in ('ECONOMY', 'LARGE')""",
    "station_context": f"""
        select id, day_date, prix, {TIES} from kept
        where id in (1, 3, 5, 7, 9)
          and day_date between date '1998-10-01' and date '1999-01-15'""",
    "price_index": f"""
        select {KEYS}, prix, avg_day_price_france, price_index, week_index from indexed""",
    "week_index": f"select {KEYS}, year, week, week_index from indexed",
    "week_index_iso": f"""
        select {KEYS},
               cast(datediff('day', date '1995-01-02', date_trunc('week', day_date)) / 7 + 1
                    as integer) as week_index
        from cleaned""",
    "dept_of_cp": """
        select id, cp, substring(lpad(cast(cp as varchar), 5, '0'), 1, 2) as dept,
               count(*) as n_rows
        from cleaned group by 1, 2, 3""",
    "sample_hash": f"""
        select id, name, prix, {TIES} from gas_raw
        where md5(concat_ws('|', 42, id, {TIES})) < '0ccccccc'""",
    "join_national_avg": f"select {KEYS}, prix, avg_day_price_france from indexed",
    "dept_map_join": """
        select areas.dept, avg_index
        from (select lpad(cast(range as varchar), 2, '0') as dept from range(1, 96)) areas
        left join (select * from dept_avg where name = 'MEDIUM') using (dept)""",
    "count_by_type": "select name, count(*) as n_rows from cleaned group by name",
    "rare_types": "select name, n_rows from rare",
    "national_daily_avg": "select * from national",
    "weekly_avg": "select * from weekly",
    "daily_avg_filtered": """
        select day_date, name, avg(prix) as avg_daily_price from kept
        where year in (1996, 1999) and name in ('LARGE', 'MEDIUM')
        group by day_date, name""",
    "dept_avg_index": "select * from dept_avg",
    "coord_avg_index": "select * from coord_avg",
    "heat_points": """
        select name, lat, "long", avg_index - 90 as weight from coord_avg where avg_index > 90""",
    "kpis": """
        select count(*) as n_rows, coalesce(avg(prix), 0) as avg_price,
               count(distinct id) as n_stations
        from cleaned where year in (1997, 1998) and name in ('ECONOMY', 'LARGE')""",
    "kpis_empty": """
        select count(*) as n_rows, coalesce(avg(prix), 0) as avg_price,
               count(distinct id) as n_stations
        from cleaned where year in (1890) and name in ('ECONOMY', 'LARGE')""",
    "filter_options": """
        select distinct 'year' as kind, cast(year as varchar) as value from kept
        union all select distinct 'name', name from kept""",
    "peak_week": "select * from weekly order by avg_weekly_price desc, week_index, name limit 1",
    "earliest_rows": f"""
        select id, name, prix, year, week from kept order by "date", id, name, {TIES} limit 5""",
    "explorer_page": f"""
        select {KEYS}, prix, week from cleaned
        where year in (1997, 1998) and name in ('ECONOMY', 'LARGE')
        order by {KEYS} limit 1000""",
    "features_lag": f"""
        select {KEYS}, prix, price_lag_1, price_lag_7 from past where price_lag_7 is not null""",
    "features_lag_wide": f"""
        select {KEYS}, prix, price_lag_1, price_lag_2, price_lag_3, price_lag_7 from past
        where price_lag_7 is not null""",
    "features_rolling": f"select {KEYS}, prix, rolling_avg_7 from past",
    "features_daily": """
        select *, lag(prix, 1) over w as price_lag_1, lag(prix, 7) over w as price_lag_7,
               avg(prix) over (w rows between 7 preceding and 1 preceding) as rolling_avg_7
        from (select id, name, day_date, avg(prix) as prix, min(lat) as lat,
                     min("long") as "long"
              from kept group by id, name, day_date)
        window w as (partition by id, name order by day_date)""",
    "features_full": f"""
        select {KEYS}, prix, price_index, week_index, price_lag_1, price_lag_7, rolling_avg_7,
               cast(dayofweek(day_date) + 1 as integer) as day_of_week, month, lat, "long"
        from past where price_lag_7 is not null""",
    "features_set_b": f"""
        select {KEYS}, prix, price_index, week_index, price_lag_1, price_lag_2, price_lag_3,
               price_lag_7, rolling_avg_7, week, month, year, lat, "long"
        from past where price_lag_7 is not null""",
    "features_set_c": f"""
        select {KEYS}, prix, price_index, week_index, price_lag_1, price_lag_2,
               price_lag_7, rolling_avg_7, week, month, year, lat, "long"
        from past where price_lag_7 is not null""",
    "split_quantile": "select quantile_disc(day_date, 0.8) as cut from forecast",
    "split_fixed": f"""
        select {KEYS}, prix, price_lag_1,
               case when day_date < {CUT} then 'train' else 'test' end as part
        from past where price_lag_1 is not null""",
    "split_dynamic": f"""
        select {KEYS}, prix, price_lag_1, price_lag_7, rolling_avg_7 from forecast
        where day_date >= (select quantile_disc(day_date, 0.8) from forecast)""",
    "split_counts": f"""
        select case when day_date < {CUT} then 'train' else 'test' end as part,
               count(*) as n_rows
        from forecast group by 1""",
    "eval_metrics": """
        select round(sqrt(avg((prix - prediction) * (prix - prediction))), 4) as rmse,
               round(avg(abs(prix - prediction)), 4) as mae,
               round(1 - sum((prix - prediction) * (prix - prediction))
                         / (var_pop(prix) * count(*)), 4) as r2
        from forecast""",
    "pred_range": """
        select least(min(prix), min(prediction)) as lower,
               greatest(max(prix), max(prediction)) as upper
        from forecast""",
    "pred_sample": f"""
        select {KEYS}, prix, prediction from forecast
        where md5(concat_ws('|', 42, id, {TIES})) < '0ccccccc'""",
    "station_forecast": f"""
        select day_date, name, prix, prediction, {TIES} from forecast
        where day_date >= {CUT}
          and id = (select min(id) from forecast where day_date >= {CUT})""",
    "model_lr_univariate": f"""
        select {KEYS}, prix, round(a + b * price_lag_1, 2) as prediction
        from forecast,
             (select regr_slope(prix, price_lag_1) as b, regr_intercept(prix, price_lag_1) as a
              from forecast where day_date < {CUT})
        where day_date >= {CUT}""",
}


SELECTS["src_csv_inferred"] = SELECTS["src_csv_gz"]
SELECTS["assemble_features"] = f"""
        select {KEYS}, prix, price_lag_1, price_lag_7, rolling_avg_7,
               cast(dayofweek(day_date) + 1 as double) as day_of_week,
               cast(month as double) as month, lat, "long"
        from past where price_lag_7 is not null"""
SELECTS["forecast_export"] = f"""
        select day_date, name, substring(lpad(cast(cp as varchar), 5, '0'), 1, 2) as dept, prix, prediction
        from forecast where day_date >= {CUT}"""
SELECTS["forecast_comparison"] = """
        select model, round(sqrt(avg((prix - p) * (prix - p))), 4) as rmse,
               round(avg(abs(prix - p)), 4) as mae,
               round(1 - sum((prix - p) * (prix - p)) / (var_pop(prix) * count(*)), 4) as r2
        from (select 'last_price' as model, prix, price_lag_1 as p from forecast
              union all select 'rolling_mean', prix, rolling_avg_7 from forecast)
        group by model"""
SELECTS["model_lr_bivariate"] = f"""
        select {KEYS}, prix, round(my + b1 * (price_lag_1 - m1) + b2 * (price_lag_7 - m2), 2) as prediction
        from forecast,
             (select my, m1, m2, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) as b1,
                     (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) as b2
              from (select avg(prix) as my, avg(price_lag_1) as m1, avg(price_lag_7) as m2,
                           covar_pop(prix, price_lag_1) as c1, covar_pop(prix, price_lag_7) as c2,
                           covar_pop(price_lag_1, price_lag_7) as v12,
                           var_pop(price_lag_1) as v1, var_pop(price_lag_7) as v2
                    from forecast where day_date < {CUT}))
        where day_date >= {CUT}"""
SELECTS["model_lr_residuals"] = """
        select unnest(['price_lag_1', 'price_lag_7', 'rolling_avg_7', 'day_of_week', 'month', 'lat',
                       'long', 'mean']) as feature, 0.0::double as correlation"""
# The best split of the month: largest sum of squared sums over counts on both sides.
SELECTS["model_rf_stump"] = f"""
        select {KEYS}, prix, round(case when month <= cut then low else high end, 2) as prediction
        from forecast,
             (select m as cut, avg(prix) filter (where month <= m) as low,
                     avg(prix) filter (where month > m) as high
              from forecast, (select unnest(range(1, 12)) as m)
              where day_date < {CUT} group by m
              order by sum(prix) filter (where month <= m) ^ 2 / count(*) filter (where month <= m)
                       + sum(prix) filter (where month > m) ^ 2 / count(*) filter (where month > m) desc
              limit 1)
        where day_date >= {CUT}"""
SELECTS["model_gbt_stump"] = SELECTS["model_rf_stump"]
SELECTS["src_csv_rejects"] = """
        select outcome, n_fields::int as n_fields, count(*) as n_lines, sum(checksum)::bigint as checksum
        from (select case when n_fields < 9 then 'too_few_fields' when n_fields > 9 then 'too_many_fields'
                          when l_orderkey % 61 = 0 then 'bad_value' else 'accepted' end as outcome, n_fields,
                     case when n_fields = 9 and l_orderkey % 61 <> 0 then last::bigint else length(line) end as checksum
              from (select *, length(line) - length(replace(line, ';', '')) + 1 as n_fields,
                           case when l_orderkey % 53 = 0 then null else prix end as last
                    from (select *, case when l_orderkey % 61 = 0 then 'x' else '' end
                                 || concat_ws(';', id, cp, pop, lat, "long", "date", "type", name,
                                              case when l_orderkey % 53 <> 0 then prix::bigint::varchar end,
                                              case when l_orderkey % 59 = 0 then 'more' end) as line
                          from gas_raw)))
        group by 1, 2"""
SELECTS["stage_incremental"] = """
        select year, count(*) as n_rows, sum(prix) as total, year in (1996, 1998) as rewritten
        from (select year, case when year = 1998 then prix + 100 else prix end as prix from cleaned where year <> 2001
              union all select year, prix from cleaned where year = 1996 and l_orderkey % 50 = 0)
        group by year"""
SELECTS["station_context_stage"] = SELECTS["station_context"]
KPIS = "count(*) as n_rows, coalesce(avg(prix), 0) as avg_price, count(distinct id) as n_stations from cleaned"
SELECTS["kpis_cube"] = f"""
        select 'all' as selection, {KPIS}
        union all select 'none', {KPIS} where year in (1890) and name in ('ECONOMY', 'LARGE')
        union all select 'one_fuel', {KPIS} where name = 'MEDIUM'
        union all select 'two_years', {KPIS} where year in (1997, 1998) and name in ('ECONOMY', 'LARGE')"""
# The tile of a place, level by level: the cell at zoom z is the one at zoom 10 without its last bits.
SELECTS["heat_tiles"] = """
        select name, zoom, tile, count(*) as n_rows, sum(hundredths)::double as total,
               case when sum(hundredths)::double / count(*) > 9000
                    then sum(hundredths)::double / count(*) - 9000 end as weight
        from (select name, zoom::int as zoom, hundredths,
                     list_sum(list_transform(range(zoom), lambda b: (((x >> (10 - zoom)) >> b) & 1) * (1 << (2 * b))
                              + (((y >> (10 - zoom)) >> b) & 1) * (1 << (2 * b + 1))))::bigint as tile_or_none,
                     coalesce(tile_or_none, 0) as tile
              from (select name, round(price_index * 100)::bigint as hundredths,
                           floor(("long" + 180) / 360 * 1024)::bigint as x, floor((lat + 90) / 180 * 1024)::bigint as y,
                           unnest(range(0, 11)) as zoom
                    from indexed where price_index is not null))
        group by name, zoom, tile"""
SELECTS["features_calendar"] = f"""
        select {KEYS}, prix, avg(prix) over (w range between 1 preceding and 1 preceding) as price_1d_ago,
               avg(prix) over (w range between 7 preceding and 7 preceding) as price_7d_ago,
               avg(prix) over (w range between 7 preceding and 1 preceding) as avg_last_7d
        from (select *, datediff('day', date '1990-01-01', day_date) as d from kept)
        window w as (partition by id, name order by d)"""
SELECTS["split_quantile_sketch"] = """
        select form, quantile_disc(day_date, 0.8) as exact_cut, count(*) as n_rows, true as is_within
        from forecast, (select unnest(['merged', 'whole']) as form) group by form"""
CUT_DAYS = "['1998-03-01', '1999-09-01', '2000-06-01']"
SELECTS["eval_by_cut"] = f"""
        select c.cut, horizon, count(*) filter (where day_date < c.cut) as n_train, count(*) filter (where is_test) as n_test,
               round(sqrt(avg(e * e) filter (where is_test)), 4) as rmse, round(avg(abs(e)) filter (where is_test), 4) as mae,
               round(1 - sum(e * e) filter (where is_test)
                         / (var_pop(prix) filter (where is_test) * count(*) filter (where is_test)), 4) as r2
        from (select cut, horizon, day_date, prix, prix - prediction as e,
                     day_date >= cut and (horizon = 'rest' or day_date < following) as is_test
              from forecast,
                   (select cut, coalesce(lead(cut) over (order by cut), date '9999-01-01') as following
                    from (select unnest({CUT_DAYS})::date as cut)),
                   (select unnest(['next', 'rest']) as horizon)) c
        group by 1, 2"""
SELECTS["model_lr_by_fuel"] = f"""
        select {KEYS}, prix, round(a + b * price_lag_1, 2) as prediction
        from forecast
        join (select name, regr_slope(prix, price_lag_1) as b, regr_intercept(prix, price_lag_1) as a
              from forecast where day_date < {CUT} group by name) using (name)
        where day_date >= {CUT}"""
SPELLED_PRICE = "case when l_orderkey % 89 = 0 or l_orderkey % 83 = 0 then null else prix end"
SELECTS["not_a_number"] = f"""
        select {KEYS}, prix, price_lag_1, price_lag_7, rolling_avg_7
        from (select {KEYS}, prix, lag(prix, 1) over w as price_lag_1, lag(prix, 7) over w as price_lag_7,
                     avg(prix) over (w rows between 7 preceding and 1 preceding) as rolling_avg_7
              from (select * replace ({SPELLED_PRICE} as prix) from kept)
              window w as (partition by id, name order by day_date, {TIES}))
        where prix is not null and price_lag_1 is not null and price_lag_7 is not null
          and rolling_avg_7 is not null"""


def statements() -> dict[str, str]:
    return {name: _with_ctes(select) for name, select in SELECTS.items()}
