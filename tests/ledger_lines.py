"""Ledger lines that several test modules use, and the text of a plan."""

from __future__ import annotations

import contextlib
import io

TRANSACTIONS_CSV = """\
hash,nonce,block_hash,block_number,transaction_index,from_address,to_address,value,gas,gas_price,input,block_timestamp,max_fee_per_gas,max_priority_fee_per_gas,transaction_type
h1,0,b,100,0,0xf,0xaa,10,21000,4,0x,1451606399,,,
h2,0,b,101,0,0xf,0xaa,30,50000,8,0x,1451606400,,,
h3,0,b,102,0,0xf,0xbb,84155363699941767867374641,60000,6,0x,1451606400,,,
h4,0,b,103,0,0xf,,5,70000,2,0x,1454284800,,,
h5,0,b,xx,0,0xf,0xaa,100,21000,4,0x,1454284800,,,
h6,0,b,104,0,0xf,0xaa,1e3,21000,4,0x,1454284800,,,
h7,0,b,105,0,0xf,0xaa,7,21000,,0x,1454284800,,,
h8,0,b,106,0,0xf,0xaa,9,21000,4,0x,bad,,,
h9,0,b,107,0,0xf,0xaa,9,21000,4,0x,1454284800,,
h10,0,b,108,0,0xf,0xaa,9,21000,4,"0x,1",1454284800,,,

"""

CONTRACTS_CSV = """\
address,bytecode,function_sighashes,is_erc20,is_erc721,block_number
0xaa,0x60,,false,false,90
0xaa,0x60,,false,false,95
0xbb,0x60,,false,false,91
0xcc,0x60,"0x1,0x2",false,false,92
"""

SCAMS_JSON = (
    '{"success": true, "result": {'
    '"0xaa": {"id": 1, "name": "A", "url": "u1", "coin": "ETH", "category": "Scam", '
    '"addresses": ["0xaa", "0xbb"], "status": "Active"}, '
    '"0xa2": {"id": 2, "name": "B", "url": "u2", "coin": "ETH", "category": "Phishing", '
    '"subcategory": "Wallet", "addresses": ["0xaa"], "status": null}, '
    '"0xa3": {"id": 3, "name": "C, Inc", "url": "u3", "coin": "ETH", "category": "Phishing", '
    '"addresses": ["0xaa"], "status": "Offline"}, '
    '"0xa4": {"id": "x4", "name": "D", "url": "u4", "coin": "ETH", "category": "Phishing", '
    '"addresses": ["0xaa"], "status": "Offline"}}}\n'
)

BLOCKS_HEADER = (
    "number,hash,parent_hash,nonce,sha3_uncles,logs_bloom,transactions_root,state_root,receipts_root,miner,"
    "difficulty,total_difficulty,size,extra_data,gas_limit,gas_used,timestamp,transaction_count,base_fee_per_gas"
)
BLOCK_ROWS = [
    "0,0xa0,0x00,0x0001,0x11,0x0000,0x21,0x31,0x41,0xm1,17,17,540,,5000,0,0,0,",
    "1,0xa1,0xa0,0x0002,0x11,0x0000,0x22,,0x42,0xm2,18,35,600,0xab,5000,0,1438269988,0,",
    "10,0xa2,0xa1,0x0003,0x11,0x0000,0x23,0x33,0x43,0xm2,19,54,700,0xabcd,5000,42000,1438270017,12,",
]
BLOCK_SHORT_ROW = "11,0xa3,0xa2,0x0004,0x11,0x0000,0x24,0x34,0x44,0xm3,20,74,9,0x,5000,42000,1438270048,2"


def plan_text(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()
