"""An index for SQL: views of its tables and functions over them."""

from __future__ import annotations

from ..operators import lookups


def register(index, name: str) -> None:
    """Temporary views NAME_bwt(pos, c), NAME_runs(run_id, start, c, len), NAME_blocks and NAME_alphabet(comp, ch, cnt, c_before) of an index,
    and temporary functions NAME_rank(c, i), how often a symbol occurs before a position, and NAME_symbol(i), the symbol there (0 outside).

    A function is one look into a block by an equi-join on its number, as in ``lookups``, so it may be used on whole tables of questions.
    """
    spark, size, total = index.blocks.sparkSession, index.block_size, index.bases
    for part, table in (("bwt", index.bwt), ("runs", index.runs()), ("blocks", index.blocks), ("alphabet", index.alphabet)):
        table.createOrReplaceTempView(f"{name}_{part}")
    last = max(0, (total - 1) // size)
    place = f"least(greatest(at_pos, 0L), {total}L)"
    ends = f"SELECT *, int({place} - start_pos) AS _o FROM {name}_blocks WHERE blk = least({place} div {size}, {last}L)"
    before = f"SELECT *, {lookups._run('_o', size)} AS _k FROM ({ends})"
    value = f"{lookups._one_of('symbol', lookups._BEFORE)} + {lookups._inside('string(symbol)')}"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_rank(symbol INT, at_pos BIGINT) RETURNS BIGINT RETURN coalesce((SELECT max(v) FROM (SELECT if(symbol BETWEEN 0 AND 5, {value}, 0L) AS v FROM ({before}))), 0L)")
    here = f"SELECT *, {lookups._run('_o + 1', size)} AS _k FROM ({ends})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_symbol(at_pos BIGINT) RETURNS INT RETURN if(at_pos >= 0 AND at_pos < {total}, (SELECT max(v) FROM (SELECT ascii(substr(sym, _k, 1)) - 48 AS v FROM ({here}))), 0)")
