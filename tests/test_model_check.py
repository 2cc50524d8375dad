"""Spark results vs. a brute-force Python model on random, skewed lines.

The generator mixes valid lines with every kind of defect the rules test
for, and sends a third of all transactions to one hot address that is both
a contract (listed twice) and a scam address.  The model applies each
question's rules with plain Python string and number functions, line by
line, and sums exactly (``Fraction``) where the library sums exactly.
"""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import pytest

from chainlens.plans import queries as Q
from chainlens.sources.ledger import read_blocks, read_contracts, read_transactions
from chainlens.sources.scam_list import read_scams

DIGITS = set("0123456789")
HOT = "0xhot"
ADDRESSES = [HOT] + [f"0x{i:03x}" for i in range(40)] + [""]


def numeric_like(s: str) -> bool:
    """Digits with at most one point among, before or behind them."""
    whole, _, rest = s.partition(".")
    return any(c in DIGITS for c in s) and all(c in DIGITS for c in whole + rest)


def month_of(seconds: int) -> str:
    moment = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    return f"{moment.month:02d}/{moment.year}"


def gen_value(rng):
    return rng.choice(
        [str(rng.randrange(0, 10**6)), str(rng.randrange(10**20, 10**26)), f"{rng.randrange(0, 999)}.{rng.randrange(0, 99)}",
         ".5", "5.", "007", "1e3", "-7", "", "1.2.3", "x"]
    )


def gen_time(rng):
    ts = rng.randrange(1438000000, 1548000000)
    return rng.choices([str(ts), f"{ts}.5", "bad", "", "-5", f"0{ts}"], weights=[80, 4, 4, 4, 4, 4])[0]


def gen_number(rng):
    return rng.choices([str(rng.randrange(1, 10**11)), "", "2.5", "abc", "1e3", ".0"], weights=[85, 3, 3, 3, 3, 3])[0]


def transaction_lines(rng, n):
    lines = ["hash,nonce,block_hash,block_number,transaction_index,from_address,to_address,value,gas,gas_price,"
             "input,block_timestamp,max_fee_per_gas,max_priority_fee_per_gas,transaction_type"]  # fmt: skip
    for k in range(n):
        to = HOT if rng.random() < 1 / 3 else rng.choice(ADDRESSES)
        block = rng.choices([str(rng.randrange(10**7)), "x1", "", "1.0"], weights=[90, 4, 3, 3])[0]
        f = [f"h{k}", "0", "b", block, "0", "0xf", to, gen_value(rng), gen_number(rng), gen_number(rng), "0x",
             gen_time(rng), "", "", ""]
        shape = rng.random()
        if shape < 0.03:
            f = f[:-1]
        elif shape < 0.06:
            f[10] = '"0x,1"'
        lines.append(",".join(f))
    lines.append("")
    return lines


def contract_lines(rng):
    lines = ["address,bytecode,function_sighashes,is_erc20,is_erc721,block_number", f"{HOT},0x,,false,false,1",
             f"{HOT},0x,,false,false,2"]
    for a in ADDRESSES[1:]:
        if rng.random() < 0.5:
            lines.append(f"{a},0x,{rng.choice(['', '\"0x1,0x2\"'])},false,false,3")
    return lines


def block_lines(rng, n):
    lines = ["number,hash,parent_hash,nonce,sha3_uncles,logs_bloom,transactions_root,state_root,receipts_root,miner,"
             "difficulty,total_difficulty,size,extra_data,gas_limit,gas_used,timestamp,transaction_count,base_fee_per_gas"]  # fmt: skip
    for k in range(n):
        miner = "0xminer_hot" if rng.random() < 1 / 3 else f"0xm{rng.randrange(30)}"
        size = rng.choices([str(rng.randrange(500, 90000)), "n/a", ""], weights=[94, 3, 3])[0]
        f = [str(k), f"0x{k:x}", "0x0", "0x1", "0x2", "0x3", "0x4", "0x5", "0x6", miner, "1", "2", size, "", "1", "2",
             "3", "4", ""]
        if rng.random() < 0.03:
            f = f[:-1]
        lines.append(",".join(f))
    return lines


def scams_doc(rng):
    result = {}
    for k in range(25):
        entry = {"id": rng.choice([k, k, k, f"x{k}"]), "name": rng.choice(["A", "B, Inc", "C"]), "url": "u",
                 "coin": "ETH", "category": rng.choice(["Scam", "Phishing", "Fake ICO"]),
                 "addresses": rng.sample(ADDRESSES, 2), "status": rng.choice(["Active", None])}
        if rng.random() < 0.5:
            entry["subcategory"] = rng.choice(["Wallet", None])
        result[f"0xentry{k}"] = entry
    return {"success": True, "result": result}


# ---- the model -------------------------------------------------------------


def model(tx_lines, contract_lines_, block_lines_, doc):
    rows = [ln.split(",") for ln in tx_lines]
    rows = [f for f in rows if len(f) == 15]
    contracts = Counter(f[0] for f in (ln.split(",") for ln in contract_lines_) if len(f) == 6)

    q1 = Counter(month_of(int(f[11])) for f in rows if f[11].isdigit())

    q2_sum, q2_n = defaultdict(Fraction), Counter()
    for f in rows:
        if numeric_like(f[7]) and f[11].isdigit():
            m = month_of(int(f[11]))
            q2_sum[m] += Fraction(Decimal(f[7]))
            q2_n[m] += 1
    q2 = {m: float(q2_sum[m] / q2_n[m]) for m in q2_n}

    sums = defaultdict(int)
    for f in rows:
        if f[3].isdigit():
            try:
                sums[f[6]] += int(f[7])
            except ValueError:
                pass
    joined = [(a, v) for a, v in sums.items() for _ in range(contracts.get(a, 0))]
    q3 = sorted(joined, key=lambda r: (-r[1], r[0]))[:10]

    # an entry counts if its id is all digits, an address of it if none of the row's fields holds a comma
    scam_rows = []
    for entry in doc["result"].values():
        shown = {k: "None" if v is None else str(v) for k, v in entry.items() if k != "addresses"}
        if not shown["id"] or set(shown["id"]) - DIGITS or any("," in v for v in shown.values()):
            continue
        kind = {"Scam": "Scamming"}.get(shown["category"], shown["category"])
        scam_rows += [(a, (shown["id"], kind)) for a in entry["addresses"] if "," not in a]
    q5_sum, q6_sum = defaultdict(Fraction), defaultdict(Fraction)
    for f in rows:
        if not numeric_like(f[7]):
            continue
        v = Fraction(Decimal(f[7]))
        for addr, key in scam_rows:
            if addr == f[6]:
                q5_sum[key] += v
                try:
                    q6_sum[(month_of(int(f[11])), *key)] += v
                except ValueError:
                    pass
    q5 = sorted(((k[0], k[1], float(v)) for k, v in q5_sum.items()), key=lambda r: (-r[2], r[0], r[1]))[:15]
    q6 = {k: float(v) for k, v in q6_sum.items()}

    q7_sum, q7_n, q8_sum, q8_n = defaultdict(Fraction), Counter(), defaultdict(Fraction), Counter()
    for f in rows:
        if numeric_like(f[9]) and numeric_like(f[11]):
            try:
                m = month_of(int(f[11]))
            except ValueError:
                continue
            q7_sum[m] += Fraction(Decimal(f[9]))
            q7_n[m] += 1
            c = contracts.get(f[6], 0)
            if c:
                try:
                    g = Fraction(Decimal(repr(float(f[8]))))
                except ValueError:
                    continue
                q8_sum[m] += g * c
                q8_n[m] += c
    q7 = {m: float(q7_sum[m] / q7_n[m]) for m in q7_n}
    q8 = {m: float(q8_sum[m] / q8_n[m]) for m in q8_n}

    miners = defaultdict(int)
    for f in (ln.split(",") for ln in block_lines_):
        if len(f) == 19 and f[1] != "hash":
            try:
                miners[f[9]] += int(f[12])
            except ValueError:
                pass
    q4 = sorted(miners.items(), key=lambda r: (-r[1], r[0]))[:10]
    return dict(q1=dict(q1), q2=q2, q3=q3, q4=q4, q5=q5, q6=q6, q7=q7, q8=q8)


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rng = random.Random(20240605)
    d = tmp_path_factory.mktemp("model")
    tx, contracts, blocks, doc = transaction_lines(rng, 4000), contract_lines(rng), block_lines(rng, 1500), scams_doc(rng)
    (d / "tx.csv").write_text("\n".join(tx) + "\n")
    (d / "contracts.csv").write_text("\n".join(contracts) + "\n")
    (d / "blocks.csv").write_text("\n".join(blocks) + "\n")
    (d / "scams.json").write_text(json.dumps(doc) + "\n")
    frames = (
        read_transactions(spark, str(d / "tx.csv")).repartition(5),
        read_contracts(spark, str(d / "contracts.csv")),
        read_blocks(spark, str(d / "blocks.csv")),
        read_scams(spark, str(d / "scams.json")),
    )
    return frames, model(tx, contracts, blocks, doc)


def approx_map(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12), k


def test_counts_and_averages(case):
    (tx, _, _, _), want = case
    assert dict(Q.monthly_transaction_count(tx).collect()) == want["q1"]
    approx_map(dict(Q.monthly_average_value(tx).collect()), want["q2"])


def test_top_services_with_hot_contract(case):
    (tx, contracts, _, _), want = case
    got = [(a, int(v)) for a, v in Q.top_services(tx, contracts).collect()]
    assert got == want["q3"]
    assert got[0][0] == HOT and got[1][0] == HOT


def test_top_miners_with_hot_miner(case):
    (_, _, blocks, _), want = case
    assert [tuple(r) for r in Q.top_miners(blocks).collect()] == want["q4"]


@pytest.mark.parametrize("bound", [None, 0])
def test_scams(case, bound):
    # bound=0 forces the pre-aggregate + shuffle join path.
    (tx, _, _, scams), want = case
    got5 = [tuple(r) for r in Q.top_scams(tx, scams, max_broadcast_bytes=bound).collect()]
    assert [r[:2] for r in got5] == [r[:2] for r in want["q5"]]
    for g, w in zip(got5, want["q5"]):
        assert g[2] == pytest.approx(w[2], rel=1e-12)
    by_month = Q.scam_value_by_month(tx, scams, max_broadcast_bytes=bound).collect()
    approx_map({(m, i, c): v for m, i, c, v in by_month}, want["q6"])


@pytest.mark.parametrize("bound", [None, 0])
def test_gas(case, bound):
    (tx, contracts, _, _), want = case
    got7 = Q.monthly_gas_price(tx).collect()
    assert [m for m, _ in got7] == sorted(want["q7"])  # month-text order
    approx_map(dict(got7), want["q7"])
    approx_map(dict(Q.monthly_contract_gas(tx, contracts, max_broadcast_bytes=bound).collect()), want["q8"])
