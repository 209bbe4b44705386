"""Independent SQL for every registered query, for DuckDB on the same tables."""

from __future__ import annotations

from checks.queries import CACHE_SIZE, DURATION, LOCAL_RATE, START_MS
from checks.rendered import DROPPED_17, DROPPED_18

# Grid constants as plain numbers, so that a wrong one in the library would show.
_O_LAT, _O_LON = "41.4760611520074e0", "(-74.91470915200739e0)"
_S_LAT, _NE_LON = "40.1270787431293e0", "(-73.56572674312929e0)"


def _km(origin: str, x: str) -> str:
    return f"abs(({x} - {origin}) * 0.017453292519943295e0 * 6371e0)"


def _we(x: str) -> str:
    return f"cast(ceil({_km(_O_LON, x)} / 0.25e0) as integer)"


def _ns(x: str) -> str:
    return f"cast(ceil({_km(_O_LAT, x)} / 0.25e0) as integer)"


def _box(lat: str, lon: str) -> str:
    return f"({lat} between {_S_LAT} and {_O_LAT} and {lon} between {_O_LON} and {_NE_LON})"


_RAW = """raw as (
  select event_id as seq, event_id * 50 as ts_ms,
         concat('m', cast(user_id as varchar)) as medallion,
         case when event_type in ('click', 'view') then 'VTS' else 'CMT' end as vendor_id,
         value / 10e0 as trip_distance, value as fare, (event_id % 7) * 0.5e0 as tip,
         40.75e0 + ((event_id * 7919) % 6) * 0.0023e0 as pickup_lat,
         -73.99e0 + ((event_id * 104729) % 5) * 0.0023e0 as pickup_lon,
         40.75e0 + ((event_id * 15485863) % 6) * 0.0023e0 as dropoff_lat,
         -73.99e0 + ((event_id * 32452843) % 5) * 0.0023e0 as dropoff_lon
  from events)"""
_TRIPS = f"""{_RAW}, trips as (
  select seq, ts_ms, medallion, vendor_id, trip_distance, fare, tip, fare + tip as gain,
         {_we('pickup_lon')} as pickup_we, {_ns('pickup_lat')} as pickup_ns,
         {_we('dropoff_lon')} as dropoff_we, {_ns('dropoff_lat')} as dropoff_ns,
         {_ns('pickup_lat')} * 599 + {_we('pickup_lon')} as pickup_cell,
         {_ns('dropoff_lat')} * 599 + {_we('dropoff_lon')} as dropoff_cell
  from raw where {_box('pickup_lat', 'pickup_lon')} and {_box('dropoff_lat', 'dropoff_lon')})"""


def _slid(size_ms: int = 150_000, slide_ms: int = 10_000, trips: str = "trips") -> str:
    """Every trip once per window that holds it."""
    reach = -(-size_ms // slide_ms)
    return f"""slid as (
  select *, (ts_ms // {slide_ms} + r.k) * {slide_ms} as window_end
  from {trips}, range(1, {reach + 1}) r(k)
  where ts_ms >= (ts_ms // {slide_ms} + r.k) * {slide_ms} - {size_ms})"""


_PROFIT = """profit as (
  select window_end, pickup_we as cell_we, pickup_ns as cell_ns, median(gain) as profit
  from slid group by all)"""
_LAST = """last as (
  select window_end, medallion, arg_max(dropoff_we, seq) as cell_we,
         arg_max(dropoff_ns, seq) as cell_ns
  from slid group by window_end, medallion)"""
_COUNTS = """counts as (
  select window_end + 10000 as window_end, cell_we, cell_ns,
         cast(count(distinct medallion) as integer) as count
  from last group by all)"""
_AREAS = """areas as (
  select window_end, cell_we, cell_ns, round(profit / count, 9) as profitability
  from profit join counts using (window_end, cell_we, cell_ns))"""


def _areas(trips: str, slid: str) -> str:
    return (f"with {trips}, {slid}, {_PROFIT}, {_LAST}, {_COUNTS}, {_AREAS} "
            "select window_end, cell_we, cell_ns, profitability from areas")


def _distance(trips: str, source: str = "trips") -> str:
    return f"""with {trips}
  select (ts_ms // 2000 + 1) * 2000 as window_end, pickup_cell as cell_id, count(*) as count,
         round(avg(trip_distance), 9) as avg_trip_distance
  from {source} where vendor_id = 'VTS' and trip_distance > 1 group by 1, 2"""


_KEPT_17 = f"seq % 50 not in {DROPPED_17}"
_KEPT_18 = f"seq % 50 not in {DROPPED_18}"


def _cached(kept: str) -> str:
    return f"""lines as (
  select *, row_number() over (order by seq) - 1 as line_no from trips),
cached as (
  select *, row_number() over (partition by block_id order by line_no) - 1 as cache_idx,
         count(*) over (partition by block_id) as cache_n
  from (select *, line_no // {CACHE_SIZE} as block_id from lines) where {kept})"""


_NANOS = 1_000_000_000 // LOCAL_RATE
_BURST_NS = 1000 * _NANOS


def _bursts(seconds: int) -> int:
    return -(-seconds * 1_000_000_000 // _BURST_NS)


def _replayed(kept: str, seconds: int = DURATION) -> str:
    total = 1000 * _bursts(seconds)
    return f"""{_TRIPS}, {_cached(kept)},
instances as (select (count(*) + {CACHE_SIZE - 1}) // {CACHE_SIZE} as instances from events),
sizes as (select distinct block_id, cache_n from cached),
emitted as (
  select c.block_id, k.emit_no, c.line_no, c.medallion, c.vendor_id, c.trip_distance,
         c.pickup_cell, c.pickup_we, c.pickup_ns, c.dropoff_we, c.dropoff_ns, c.gain,
         {START_MS} + (k.emit_no // 1000) * {_BURST_NS} // 1000000 as arrival_ms,
         {START_MS} + (k.emit_no // 1000) * {_BURST_NS} // 1000000 as ts_ms,
         k.emit_no * instances + c.block_id as seq
  from sizes, instances, range(0, {total}) k(emit_no)
  join cached c on c.block_id = sizes.block_id and c.cache_idx = k.emit_no % sizes.cache_n)"""


_SAMPLES = f"""{_replayed(_KEPT_17)},
marks as (select block_id, arrival_ms, emit_no from emitted where emit_no % 1000 = 0),
steps as (
  select block_id, row_number() over w - 1 as sample_no, emit_no - lag(emit_no) over w as events,
         arrival_ms - lag(arrival_ms) over w as interval_ms
  from marks window w as (partition by block_id order by arrival_ms)),
samples as (select block_id, sample_no, events / interval_ms * 1000e0 as rate
            from steps where interval_ms is not null)"""

_EVENT_LOG = f"""with {_replayed(_KEPT_17)},
spans as (select block_id, min(arrival_ms) as a, max(arrival_ms) as b from emitted group by 1),
marks as (select block_id, 'Started' as action, a as at_ms from spans
          union all select block_id, 'Ended', b from spans)
select block_id, action, at_ms,
       concat('throughput_results_q0_subtask_', block_id, ' Processing ', action, ': ',
              strftime(make_timestamp(at_ms * 1000), '%Y-%m-%d %H:%M:%S.%g'),
              ' (', at_ms, ')') as line
from marks"""

_REPORT = f"""with {_SAMPLES},
totals as (select block_id, count(*) as n from emitted group by 1),
ends as (select *, row_number() over (partition by block_id order by sample_no) as i,
                count(*) over (partition by block_id) as k from samples),
steady as (select t.block_id, coalesce(avg(rate), 0e0) as rate from totals t
           left join ends e on e.block_id = t.block_id and (k < 3 or (i > 1 and i < k)) group by 1)
select block_id, 0 as part, 0 as line_no,
       concat('--- Subtask ', block_id, ' Throughput Samples (events/sec) ---') as value from steady
union all
select block_id, 1, sample_no, concat('Sample ', sample_no, ': ', cast(rate as varchar)) from samples
union all
select block_id, 2, 0, repeat('-', 53) from steady
union all
select block_id, 2, 1, concat('Subtask ', block_id,
       ' Steady-State Average Throughput (events/sec): ', cast(rate as varchar)) from steady
union all
select block_id, 2, 2, concat('Subtask ', block_id, ' Total Events Emitted: ', n) from totals"""

_TOTALS = """with lines as (
  select *, event_id % 10 = 3 or event_type = 'signup' as silent from events)
select concat('run=r', (event_id // 500) * 10, case when silent then 's' else '' end) as run,
       round(sum(case when silent then 0e0 else value * 1e6 end), 2) as total_throughput
from lines group by 1"""

_LAT = "(39.9e0 + ((event_id * 7919) % 1000) * 0.0017e0)"
_LON = "(-75.1e0 + ((event_id * 104729) % 1000) * 0.0017e0)"
_GRID = f"""with p as (select event_id, {_LAT} as lat, {_LON} as lon from events),
c as (select *, {_box('lat', 'lon')} as in_box, {_we('lon')} as we, {_ns('lat')} as ns from p),
g as (select *, in_box and we between 1 and 600 and ns between 1 and 600 as in_grid from c)
select event_id, in_box, in_grid, we, ns,
       case when in_grid then concat(we, '.', ns) end as text_id,
       case when in_grid then ns * 599 + we end as flat_id,
       round({_km(_O_LAT, 'lat')}, 6) as km_south,
       round((lat + 0.25e0 / 6371e0 * 57.29577951308232e0)
             - (lat - 0.25e0 / 6371e0 * 57.29577951308232e0), 9) as span,
       round((lon + 0.25e0 / 6371e0 * 57.29577951308232e0)
             - (lon - 0.25e0 / 6371e0 * 57.29577951308232e0), 9) as width
from g"""

_STEADY = """with s as (
  select user_id, value as rate,
         row_number() over (partition by user_id order by event_id) as i,
         count(*) over (partition by user_id) as n
  from events),
m as (select user_id, avg(rate) as steady_rate from s
      where n < 3 or (i > 1 and i < n) group by user_id)
select u.user_id, round(coalesce(steady_rate, 0e0), 9) as steady_rate
from (select distinct user_id from events) u left join m using (user_id)"""

_STEADY_BY_TYPE = """with s as (
  select user_id, event_id // 100 as hour, value as rate,
         row_number() over (partition by user_id, event_id // 100 order by event_id) as i,
         count(*) over (partition by user_id, event_id // 100) as n
  from events where event_type <> 'click'),
m as (select user_id, hour, avg(rate) as steady_rate from s
      where n < 3 or (i > 1 and i < n) group by user_id, hour)
select u.user_id, u.hour, round(coalesce(steady_rate, 0e0), 9) as steady_rate
from (select distinct user_id, event_id // 100 as hour from events) u left join m using (user_id, hour)"""

_DENSE = """with recursive c as (
  select user_id, (event_id // 400) * 700 + (event_id % 3) * 150 as t_ms, max(event_id) as total
  from events group by 1, 2),
taken as (
  select user_id, t_ms, total, cast(0 as bigint) as sample_no, cast(0 as double) as rate
  from (select *, row_number() over (partition by user_id order by t_ms) as i from c) where i = 1
  union all
  select user_id, t_ms, total, sample_no, rate from (
    select k.user_id, c.t_ms, c.total, k.sample_no + 1 as sample_no,
           (c.total - k.total) / (c.t_ms - k.t_ms) * 1000e0 as rate,
           row_number() over (partition by k.user_id order by c.t_ms) as i
    from taken k join c on c.user_id = k.user_id and c.t_ms >= k.t_ms + 1000) where i = 1)
select user_id, sample_no, round(rate, 9) as rate from taken where sample_no > 0"""

_ROUND_TRIP = """with s as (
  select user_id, value as rate, row_number() over (partition by user_id order by event_id) as i,
         count(*) over (partition by user_id) as n from events),
m as (select user_id, avg(rate) as r from s where n < 3 or (i > 1 and i < n) group by 1)
select 'run1' as run, round(sum(r), 6) as total_throughput from m"""

_LATE = f"""with {_TRIPS}, last as (select max(ts_ms) as ms from trips),
mark as (select max(ts_ms) as ms from trips, last where ts_ms <= 0.75 * last.ms)
select f.files::integer as files, 1::bigint as batch, seq, ts_ms, pickup_cell, trip_distance
from trips, last, mark, (values (1), (8)) f(files)
where ts_ms < 0.25 * last.ms and (ts_ms // 2000 + 1) * 2000 <= mark.ms"""

_HOT = f"""with {_TRIPS}, {_slid()} select window_end, 300 as cell_we, 301 as cell_ns, round(median(gain), 9) as profit
from slid group by 1"""

_SECONDS = f"lines as (select * exclude (ts_ms), ts_ms // 1000 * 1000 as ts_ms from trips where {_KEPT_17})"

_TEXT_LAST = (f"with {_TRIPS}, {_SECONDS}, {_slid(trips='lines')}, {_LAST} "
              "select window_end, medallion, cell_we, cell_ns from last")

_LANDED = f"""with {_TRIPS}, {_SECONDS}
select ts_ms, medallion, fare, row_number() over (partition by ts_ms order by seq) as place from lines"""

_STREAM_TOTALS = f"""with {_TRIPS}, q(query_id) as (values ('distance'), ('profit'))
select query_id, 3::bigint as batches, (select count(*) + 1 from trips) as total_events from q"""

_STREAM_REPORT = f"""with {_TRIPS}, q(query_id) as (values ('distance'), ('profit'))
select query_id, 0 as part, 0::bigint as line_no, '--- Subtask ' || query_id || ' Throughput Samples (events/sec) ---' as value from q
union all select query_id, 2, 0, repeat('-', 53) from q
union all select query_id, 2, 2, 'Subtask ' || query_id || ' Total Events Emitted: ' || (select count(*) + 1 from trips) from q"""

# A pane lives until the watermark, the latest time, has passed it; then its windows do. The taxis' time is
# a slide ahead. What is counted or joined leaves its state at once.
_AUDIT = f"""with {_TRIPS}, wm as (select max(ts_ms) as ms from trips),
r(k) as (select * from range(1, 16)),
own as (select *, (ts_ms // 10000 + 1) * 10000 as pane, ts_ms // 10000 * 10000 as t from trips),
ahead as (select *, (ts_ms // 10000 + 2) * 10000 as pane, ts_ms // 10000 * 10000 + 10000 as t from trips)
select distinct 1::bigint as operator_id, 'stateStoreSave' as operator, t + 10000 * k as window_end, pickup_we as cell_we, pickup_ns as cell_ns,
       null::varchar as medallion, null::double as gain from own, r, wm where pane <= wm.ms and t + 10000 * k > wm.ms
union all select distinct 2, 'stateStoreSave', pane, pickup_we, pickup_ns, null, round(gain, 9) from own, wm where pane > wm.ms
union all select distinct 4, 'stateStoreSave', t + 10000 * k, null, null, medallion, null from ahead, r, wm where pane <= wm.ms and t + 10000 * k > wm.ms
union all select distinct 5, 'stateStoreSave', pane, null, null, medallion, null from ahead, wm where pane > wm.ms"""

_CHECKED = f"""with {_TRIPS}, {_slid()}, {_PROFIT}, {_LAST}, {_COUNTS}, {_AREAS},
pairs as (select window_end, count(*) as pairs from areas group by 1)
select window_end, count(*) as groups, any_value(pairs) as pairs from counts left join pairs using (window_end) group by 1"""

_CHECKPOINTS = """with c as (select user_id, event_id * 1000 as t_ms, event_id * event_id as total
                          from events),
s as (select user_id, row_number() over w - 1 as sample_no,
             t_ms - lag(t_ms) over w as interval_ms, total - lag(total) over w as events
      from c window w as (partition by user_id order by t_ms))
select user_id, sample_no, round(events / interval_ms * 1000e0, 9) as rate
from s where interval_ms > 0"""

_PROFITABLE = _areas(_TRIPS, _slid())
_TOTAL_PROFIT = (
    f"with {_TRIPS}, {_slid()} select window_end, pickup_we as cell_we, pickup_ns as cell_ns, "
    "round(sum(gain), 6) as total_profit from slid group by 1, 2, 3")
_TRIP_DISTANCE = _distance(_TRIPS)
_PROFIT_BY_CELL = (f"with {_TRIPS}, {_slid()}, {_PROFIT} "
                   "select window_end, cell_we, cell_ns, round(profit, 9) as profit from profit")
_TAXI_COUNT = (f"with {_TRIPS}, {_slid()}, {_LAST}, {_COUNTS} "
               "select window_end, cell_we, cell_ns, count from counts")
_TOP = (
    f"with {_TRIPS}, {_slid()}, {_PROFIT}, {_LAST}, {_COUNTS}, {_AREAS} "
    "select * from (select window_end, cell_we, cell_ns, profitability, "
    "cast(row_number() over (partition by window_end "
    "order by profitability desc, cell_we, cell_ns) as integer) as rank from areas) "
    "where rank <= 5")

ORACLES: dict[str, str] = {
    "profitable_areas": _PROFITABLE,
    "profitable_areas_15min": _areas(_TRIPS, _slid(900_000)),
    "profitable_areas_split": _PROFITABLE,
    "trip_distance": _TRIP_DISTANCE,
    "profit_by_cell": _PROFIT_BY_CELL,
    "profit_by_cell_uneven": (
        f"with {_TRIPS}, {_slid(25_000)}, {_PROFIT} "
        "select window_end, cell_we, cell_ns, round(profit, 9) as profit from profit"),
    "total_profit_by_cell": _TOTAL_PROFIT,
    "last_dropoff_by_taxi": (
        f"with {_TRIPS}, {_slid()}, {_LAST} "
        "select window_end, medallion, cell_we, cell_ns from last"),
    "empty_taxi_count": _TAXI_COUNT,
    "top_profitable_cells": _TOP,
    "grid_cells": _GRID,
    "cell_key_roundtrip": (
        f"with {_TRIPS}, k as (select *, (pickup_we << 16) | (pickup_ns & 65535) as cell_key "
        "from trips) select seq, cell_key, cell_key >> 16 as we, cell_key & 65535 as ns, "
        "(cell_key & 65535) * 599 + (cell_key >> 16) as flat_id from k"),
    "ingest_trips17": (
        f"with {_TRIPS} select medallion, pickup_we, pickup_ns, dropoff_we, dropoff_ns, fare, tip, "
        f"ts_ms // 1000 * 1000 as dropoff_ms from trips where {_KEPT_17}"),
    "ingest_trips18": (
        f"with {_TRIPS} select vendor_id, pickup_cell, dropoff_cell, trip_distance "
        f"from trips where {_KEPT_18}"),
    "block_scan": (
        f"with {_TRIPS}, {_cached(_KEPT_17)} "
        "select block_id, line_no, medallion, cache_idx, cache_n from cached"),
    "replay_events": (
        f"with {_replayed(_KEPT_17)} "
        "select block_id, emit_no, arrival_ms, line_no, medallion, seq from emitted"),
    "emitted_totals": (
        f"with {_replayed(_KEPT_17)} "
        "select block_id, count(*) as total_events from emitted group by 1"),
    "throughput_samples": (
        f"with {_SAMPLES} select block_id, sample_no, rate from samples"),
    "checkpoint_samples": _CHECKPOINTS,
    "checkpoint_samples_dense": _DENSE,
    "steady_state_throughput": _STEADY,
    "steady_state_by_type": _STEADY_BY_TYPE,
    "report_round_trip": _ROUND_TRIP,
    "source_report": _REPORT,
    "run_event_log": _EVENT_LOG,
    "throughput_summary": _TOTALS,
    "throughput_result_lines": (
        f"select run, concat('Total Processed Throughput: ', printf('%.2f', total_throughput), "
        f"' events/sec') as value from ({_TOTALS})"),
    "replicated_distance": (
        f"select cast(q.query_id as integer) as query_id, d.* from ({_TRIP_DISTANCE}) d, range(0, 4) q(query_id)"),
    "replayed_profitable_areas": _areas(_replayed(_KEPT_17, 20), _slid(trips="emitted")),
    "replayed_trip_distance": _distance(_replayed(_KEPT_18), "emitted"),
    "stream_profitable_areas": _PROFITABLE,
    "stream_top_profitable_cells": _TOP,
    "stream_trip_distance": _TRIP_DISTANCE,
    "stream_profit_by_cell": _PROFIT_BY_CELL,
    "stream_empty_taxi_count": _TAXI_COUNT,
    "stream_total_profit_by_cell": _TOTAL_PROFIT,
    "stream_text_trip_distance": _distance(_TRIPS + f", kept as (select * from trips where {_KEPT_18})", "kept"),
    "stream_text_profitable_areas": _areas(
        _TRIPS + f", kept as (select * from trips where {_KEPT_17})", _slid(trips="kept")),
    "stream_late_rows": _LATE,
    "stream_on_time_distance": _TRIP_DISTANCE,
    "stream_text_last_dropoff": _TEXT_LAST,
    "landed_order": _LANDED,
    "arrival_stamps": f"with {_TRIPS} select count(*) as n, count(*) as n_stamped from trips where {_KEPT_18}",
    "stream_emitted_totals": _STREAM_TOTALS,
    "stream_source_report": _STREAM_REPORT,
    "stream_state_audit": _AUDIT,
    "stream_profit_by_cell_hot": _HOT,
    "stream_profitable_areas_split": _PROFITABLE,
    "stream_replicated_distance": (
        f"select cast(q.query_id as integer) as query_id, d.* from ({_TRIP_DISTANCE}) d, range(0, 4) q(query_id)"),
    "checked_groups": _CHECKED,
    "discarded_rows": f"select count(*) as n, sum(count)::bigint as trips from ({_TRIP_DISTANCE})",
    "block_scan_some": (
        f"with {_TRIPS}, {_cached(_KEPT_17)} "
        "select block_id, line_no, medallion, cache_idx, cache_n from cached where block_id % 6 = 1"),
}
