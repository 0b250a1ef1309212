"""Rules over the ticks of one (symbol, session), written on columns; the batch and the streaming operators call the same functions.

``carry`` is what an earlier part of the session leaves behind, so a session may arrive in one piece or in many micro-batches.
"""
from __future__ import annotations

import numpy as np
import pandas as pd

# Round lots by price band, share of the old total that marks a counter reset, limits in milliseconds.
LOT_PRICES, LOTS = [250, 1000, 10000], [100, 40, 10, 1]
RESET_SHARE, TRADE_AGE_MS, TRADE_GAP_MS = 0.2, 2_000, 10_000
BAR = ["minute", "open", "high", "low", "close", "volume"]
QUOTE_CARRY = ["price", "size", "eligible", "fresh", "total", "day_high", "day_low", *BAR]


def _held(values: pd.Series, before) -> pd.Series:
    """The last known value at every row."""
    held = values.ffill()
    return held if before is None else held.fillna(before)


def counter_growth(total: np.ndarray, before: float | None) -> tuple[np.ndarray, float | None]:
    """Growth of a cumulative counter at each reading, and its last value.

    Inside an epoch only a new maximum is growth.  A reading below ``RESET_SHARE`` of the epoch's maximum opens a new epoch and is growth as a
    whole.  The very first reading is a baseline.
    """
    growth = np.zeros(len(total))
    at, top = 0, before
    while at < len(total):
        rest = total[at:]
        tops = np.maximum.accumulate(rest if top is None else np.append(top, rest))[:len(rest)]  # the maximum before each reading; for a baseline its own
        reset = np.flatnonzero(rest < RESET_SHARE * tops)
        n = int(reset[0]) if len(reset) else len(rest)
        growth[at:at + n] = np.maximum(rest[:n] - tops[:n], 0)
        if top is None and n > 1:
            growth[at + 1:at + n] = np.maximum(rest[1:n] - np.maximum.accumulate(rest)[:n - 1], 0)
        top = max([*rest[:n], *([] if top is None else [top])], default=None)
        at += n
        if len(reset):
            growth[at], top, at = max(total[at], 0), total[at], at + 1
    return growth, top


def quote_bars(rows: pd.DataFrame, carry: dict | None) -> tuple[pd.DataFrame, dict]:
    """Finished minute bars of ordered quote updates, and the carry with the minute still open.

    A price counts from round lots only; a minute's volume is the growth of the day's total; a day extreme that moves with a print belongs to the
    minute of that print.
    """
    c = dict.fromkeys(QUOTE_CARRY) | {"fresh": False} | (carry or {})
    r = rows.reset_index(drop=True)
    own, size = r["last"].where(r["last"] > 0), r["last_size"]
    price, lot_size = _held(own, c["price"]), _held(size, c["size"])
    lot = pd.Series(np.array(LOTS)[np.searchsorted(LOT_PRICES, price.fillna(0), "left")])
    round_lots = price.notna() & (lot_size.isna() | (lot_size >= lot))
    update = round_lots & (r["last"].notna() | size.notna())
    eligible = _held(price.where(update), c["eligible"])
    high, low = r["day_high"].where(r["day_high"] != 0), r["day_low"].where(r["day_low"] != 0)
    above = high > _held(high, c["day_high"]).shift(fill_value=c["day_high"] if c["day_high"] is not None else np.nan)
    below = (low > 0) & (low < _held(low, c["day_low"]).shift(fill_value=c["day_low"] if c["day_low"] is not None else np.nan))
    told = np.flatnonzero(r["total_volume"].notna())
    growth, total = counter_growth(r["total_volume"].to_numpy(np.float64)[told], c["total"])
    traded = pd.Series(0.0, index=r.index)
    traded.iloc[told] = growth
    prints = traded > 0
    # an update waits for the next print; a baseline clears what waits
    clears = prints.copy()
    if c["total"] is None and len(told):
        clears.iloc[told[0]] = True
    seen = update.cumsum() + int(c["fresh"])
    used = seen.where(clears).ffill().fillna(0)
    waits = seen > used.shift(fill_value=0)
    minute = r["receipt_ms"] // 60_000
    p = pd.DataFrame({"minute": minute, "traded": traded, "eligible": eligible, "waits": waits, "may": waits | round_lots, "up": high.where(above), "down": low.where(below)})[prints]
    before = c["minute"] is not None
    opened = before and c["open"] is not None
    first = p["may"] & (p["may"].groupby(p["minute"]).cumsum() == 1)
    if opened:
        first &= p["minute"] != c["minute"]
    priced = p["waits"] | first
    p["price"] = p["eligible"].where(priced)
    begun = priced.groupby(p["minute"]).cumsum() > 0
    if opened:
        begun |= p["minute"] == c["minute"]
    p["up"], p["down"] = p["up"].where(begun), p["down"].where(begun)
    bars = p.groupby("minute").agg(open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"), volume=("traded", "sum"), up=("up", "max"), down=("down", "min")).reset_index()
    bars["high"], bars["low"] = bars[["high", "up"]].max(axis=1), bars[["low", "down"]].min(axis=1)
    if before:
        held = pd.DataFrame([{k: c[k] for k in BAR}]).astype({k: "float64" for k in BAR[1:]})
        if len(bars) and bars.loc[0, "minute"] == c["minute"]:
            b = bars.iloc[0]
            held.loc[0, "open"] = b["open"] if c["open"] is None else c["open"]
            held.loc[0, "close"] = c["close"] if pd.isna(b["close"]) else b["close"]
            held.loc[0, "high"], held.loc[0, "low"] = np.nanmax([held.loc[0, "high"], b["high"], -np.inf]), np.nanmin([held.loc[0, "low"], b["low"], np.inf])
            held.loc[0, "volume"] += b["volume"]
            bars = bars.iloc[1:]
        bars = pd.concat([held, bars[BAR]], ignore_index=True) if len(bars) else held
    bars = bars[BAR]
    none = lambda v: None if v is None or v != v else v
    last = lambda s, old: none(s.iloc[-1]) if len(s) else old
    after = {"price": last(price, c["price"]), "size": last(lot_size, c["size"]), "eligible": last(eligible, c["eligible"]), "total": total,
             "day_high": last(_held(high, c["day_high"]), c["day_high"]), "day_low": last(_held(low, c["day_low"]), c["day_low"]),
             "fresh": bool(seen.iloc[-1] > used.iloc[-1]) if len(r) else c["fresh"]}
    open_bar = {k: none(bars.iloc[-1][k]) for k in BAR} if len(bars) else dict.fromkeys(BAR)
    return finished(bars.iloc[:-1]), after | open_bar


def finished(bars: pd.DataFrame) -> pd.DataFrame:
    """Bars that saw a round lot."""
    return bars[bars["open"].notna()].astype({"minute": "int64"})


CROSS_CARRY = ["trade_ms", "price", "generation", "range_id", "held", "fired"]


def first_cross(rows: pd.DataFrame, carry: dict | None) -> tuple[pd.DataFrame, dict]:
    """The first trade that crosses above the opening range, if it is among the ordered ``rows``, and the carry.

    A trade is held when it is trusted, in time and after the range.  A held trade crosses when the one held just before belongs to the same
    generation and range, lies at most ``TRADE_GAP_MS`` back and was not above the range.  A repeated stamp is passed over.  A trade older than
    the held one breaks the stretch: nothing is held after it.
    """
    c = dict.fromkeys(CROSS_CARRY) | {"held": False, "fired": False} | (carry or {})
    if c["fired"] or not len(rows):
        return rows.iloc[:0], c
    got = {k: rows[k].to_numpy() for k in ("trade_ms", "receipt_ms", "price", "generation", "range_id", "et_min", "interval", "or_high")}
    late = got["receipt_ms"] - got["trade_ms"]
    trusted = rows["trusted"].to_numpy()
    if trusted.dtype != bool:       # missing ones are not trusted
        trusted = np.array([t is not None and t == True for t in trusted], bool)  # noqa: E712
    good = trusted & (got["price"] > 0) & (got["et_min"] >= 570 + got["interval"]) & (got["et_min"] < 960) & (late >= 0) & (late <= TRADE_AGE_MS)
    held_before = {"trade_ms": c["trade_ms"] or 0, "price": c["price"] or 0.0, "generation": c["generation"] or 0, "range_id": c["range_id"] or ""}
    chain = {k: np.concatenate([np.array([v], {"price": float, "range_id": object}.get(k, got[k].dtype)), got[k]]) for k, v in held_before.items()}
    ms, is_good, price, bound = chain["trade_ms"].astype(np.int64), np.append(c["held"], good), chain["price"], got["or_high"]
    generation, range_id = chain["generation"], chain["range_id"]
    same = np.zeros(len(ms), bool)
    same[1:] = is_good[1:] & is_good[:-1] & (generation[1:] == generation[:-1]) & (range_id[1:] == range_id[:-1])
    # in a run of falling stamps every other trade breaks the stretch: after a break the next one starts anew
    falls = np.zeros(len(ms), bool)
    falls[1:] = same[1:] & (ms[1:] < ms[:-1])
    place = np.arange(len(ms)) - np.maximum.accumulate(np.where(~falls, np.arange(len(ms)), 0))
    breaks = falls & (place % 2 == 1)
    held = is_good & ~breaks
    repeats = np.zeros(len(ms), bool)
    repeats[1:] = same[1:] & (ms[1:] == ms[:-1])
    repeats &= held & np.append(False, held[:-1])
    keep = np.flatnonzero(~repeats)
    at, prev = keep[1:], keep[:-1]
    linked = held[at] & held[prev] & (generation[at] == generation[prev]) & (range_id[at] == range_id[prev])
    gap = ms[at] - ms[prev]
    crossing = at[linked & (gap > 0) & (gap <= TRADE_GAP_MS) & (price[prev] <= bound[at - 1]) & (price[at] > bound[at - 1])] if len(at) else at
    last = keep[-1]
    after = {"trade_ms": int(ms[last]), "price": float(price[last]), "generation": int(generation[last]), "range_id": str(range_id[last]), "held": bool(held[last]), "fired": bool(len(crossing))}
    return rows.iloc[crossing[:1] - 1], after
