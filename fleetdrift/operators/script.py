"""Migration statements, transaction units and lock estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.functions.names import qualified_name, quote_ident
from fleetdrift.operators.risk import risk_label, risk_rank
from fleetdrift.skew import running


def _text(*parts: Column | str) -> Column:
    """Parts joined by blanks; null parts are left out."""
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _name_list(names: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(names, quote_ident), ", "), F.lit(")"))


def _quoted_text(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def column_definition(column: Column) -> Column:
    """A column as it stands in CREATE TABLE or ADD COLUMN."""
    timing = F.when(column["identity"]["generated"] == "always", F.lit("ALWAYS")).otherwise(
        F.lit("BY DEFAULT")
    )
    return _text(
        quote_ident(column["name"]),
        column["data_type"],
        F.concat(F.lit("COLLATE "), quote_ident(column["collation"])),
        F.concat(F.lit("DEFAULT "), column["default_expr"]),
        F.when(
            column["identity"].isNotNull(),
            F.concat(F.lit("GENERATED "), timing, F.lit(" AS IDENTITY")),
        ),
        F.concat(F.lit("GENERATED ALWAYS AS ("), column["generated_expression"], F.lit(") STORED")),
        F.when(~column["nullable"], F.lit("NOT NULL")),
    )


def constraint_definition(constraint: Column) -> Column:
    """A constraint as it stands in ADD CONSTRAINT."""
    c = constraint

    def action(event: str, value: Column) -> Column:
        words = F.upper(F.replace(value, F.lit("_"), F.lit(" ")))
        return F.when(value != "no_action", F.concat(F.lit(f"ON {event} "), words))

    elements = F.array_join(
        F.transform(
            c["elements"],
            lambda e: _text(e["column_or_expr"], e["opclass"], "WITH", F.rtrim(e["operator"], F.lit(","))),
        ),
        ", ",
    )
    body = (
        F.when(c["kind"] == "primary_key", _text("PRIMARY KEY", _name_list(c["columns"])))
        .when(
            c["kind"] == "unique",
            _text(
                "UNIQUE",
                F.when(c["nulls_not_distinct"], F.lit("NULLS NOT DISTINCT")),
                _name_list(c["columns"]),
            ),
        )
        .when(
            # an expression that could not be taken apart is the whole definition
            (c["kind"] == "check") & c["expression"].rlike("(?i)^CHECK"),
            c["expression"],
        )
        .when(
            c["kind"] == "check",
            _text(
                F.concat(F.lit("CHECK ("), c["expression"], F.lit(")")),
                F.when(c["no_inherit"], F.lit("NO INHERIT")),
            ),
        )
        .when(
            c["kind"] == "foreign_key",
            _text(
                "FOREIGN KEY",
                _name_list(c["columns"]),
                "REFERENCES",
                qualified_name(c["ref_namespace"], c["ref_table"]),
                _name_list(c["ref_columns"]),
                F.when(c["match_type"] != "simple", F.concat(F.lit("MATCH "), F.upper(c["match_type"]))),
                action("DELETE", c["on_delete"]),
                action("UPDATE", c["on_update"]),
            ),
        )
        .when(
            c["kind"] == "exclusion",
            _text(
                "EXCLUDE USING",
                c["index_method"],
                F.concat(F.lit("("), elements, F.lit(")")),
                F.concat(F.lit("WHERE ("), c["predicate"], F.lit(")")),
            ),
        )
    )
    deferral = (
        F.when(c["deferrability"] == "deferrable_initially_deferred", F.lit("DEFERRABLE INITIALLY DEFERRED"))
        .when(c["deferrability"] == "deferrable_initially_immediate", F.lit("DEFERRABLE"))
    )
    return _text(body, deferral)


def index_definition(namespace: Column, index: Column) -> Column:
    """CREATE INDEX CONCURRENTLY of an index."""
    keys = F.array_join(
        F.transform(
            index["key_columns"],
            # an expression carries its own suffix words
            lambda k: F.coalesce(
                k["expression"],
                _text(
                    quote_ident(k["column_name"]),
                    k["opclass"],
                    F.when(k["sort_order"] == "desc", F.lit("DESC")),
                    F.concat(F.lit("NULLS "), F.upper(k["nulls_order"])),
                ),
            ),
        ),
        ", ",
    )
    return _text(
        F.when(index["unique"], F.lit("CREATE UNIQUE INDEX CONCURRENTLY")).otherwise(
            F.lit("CREATE INDEX CONCURRENTLY")
        ),
        quote_ident(index["name"]),
        "ON",
        qualified_name(namespace, index["table_name"]),
        "USING",
        index["method"],
        F.concat(F.lit("("), keys, F.lit(")")),
        F.when(
            F.size(index["include_columns"]) > 0, _text("INCLUDE", _name_list(index["include_columns"]))
        ),
        F.concat(F.lit("WHERE "), index["predicate"]),
    )


def _statements() -> tuple[Column, Column]:
    """Forward and rollback statements of a change row, as arrays."""
    kind = F.col("kind")
    own = qualified_name(F.col("namespace"), F.col("name"))
    alter_table = _text("ALTER TABLE", qualified_name(F.col("namespace"), F.col("parent_name")))
    name = quote_ident(F.col("name"))
    column, old = F.col("column"), F.col("old_column")
    alter_column = _text(alter_table, "ALTER COLUMN", name)
    parts = F.concat(
        F.transform(F.coalesce("table_columns", F.array()), column_definition),
        F.transform(
            F.coalesce("table_constraints", F.array()),
            lambda c: _text("CONSTRAINT", quote_ident(c["name"]), constraint_definition(c)),
        ),
    )

    def create_table(side: str) -> list[Column]:
        """A table with all its attributes: those of the target, or of the source to bring it back."""
        info, parent = F.col(f"{side}_partition_info"), F.col(f"{side}_partition_of")
        owner, comment = F.col(f"{side}_owner"), F.col(f"{side}_comment")
        words = info["partition_key"]
        divided = F.when(words.rlike("(?i)^(range|list|hash)"), words).otherwise(_text(F.upper(info["strategy"]), words))
        return [
            _text(
                "CREATE TABLE", own, F.concat(F.lit("("), F.array_join(parts, ", "), F.lit(")")),
                F.concat(F.lit("PARTITION BY "), F.when(info.isNotNull(), divided)),
                F.concat(F.lit("TABLESPACE "), quote_ident(F.col(f"{side}_tablespace"))),
            ),
            F.when(owner.isNotNull(), _text("ALTER TABLE", own, "OWNER TO", quote_ident(owner))),
            F.when(
                parent.isNotNull(),
                _text(
                    "ALTER TABLE", qualified_name(parent["parent_namespace"], parent["parent_name"]),
                    "ATTACH PARTITION", own, parent["partition_bound"],
                ),
            ),
            F.when(comment.isNotNull(), _text("COMMENT ON TABLE", own, "IS", _quoted_text(comment))),
        ]

    drop_table, drop_column = _text("DROP TABLE", own), _text(alter_table, "DROP COLUMN", name)
    constraint = F.col("constraint")
    deferred_check = constraint["kind"].isin("check", "foreign_key")
    add_constraint = _text(
        alter_table,
        "ADD CONSTRAINT",
        name,
        constraint_definition(constraint),
        F.when(deferred_check, F.lit("NOT VALID")),
    )
    validate = F.when(deferred_check, _text(alter_table, "VALIDATE CONSTRAINT", name))
    drop_constraint = _text(alter_table, "DROP CONSTRAINT", name)
    drop_index = _text("DROP INDEX CONCURRENTLY", own)
    create_schema, drop_schema = _text("CREATE SCHEMA", name), _text("DROP SCHEMA", name)
    drop_extension = _text("DROP EXTENSION", name)

    def create_extension(version: str) -> Column:
        return _text("CREATE EXTENSION", name, F.concat(F.lit("VERSION "), _quoted_text(F.col(version))))

    def set_type(data_type: Column, collation: Column) -> Column:
        return _text(
            alter_column,
            "TYPE",
            data_type,
            F.concat(F.lit("COLLATE "), quote_ident(collation)),
            F.concat(F.lit("USING "), F.col("using_expression")),
        )

    def set_default(expression: Column) -> Column:
        return F.when(expression.isNull(), _text(alter_column, "DROP DEFAULT")).otherwise(
            _text(alter_column, "SET DEFAULT", expression)
        )

    def set_nullable(nullable: Column) -> Column:
        return F.when(nullable, _text(alter_column, "DROP NOT NULL")).otherwise(
            _text(alter_column, "SET NOT NULL")
        )

    def rename(prefix: Column, old_name: str, new_name: str) -> Column:
        return _text(prefix, quote_ident(F.col(old_name)), "TO", quote_ident(F.col(new_name)))

    def rename_table(old_name: str, new_name: str) -> Column:
        table = qualified_name(F.col("namespace"), F.col(old_name))
        return _text("ALTER TABLE", table, "RENAME TO", quote_ident(F.col(new_name)))

    def attributes(side: str, other: str) -> list[Column]:
        """Statements that bring every changed attribute to its value on one side."""

        def when_changed(attribute: str, statement: Column) -> Column:
            return F.when(F.array_contains("changed", attribute), statement)

        def partition(value: Column) -> Column:
            return qualified_name(value["parent_namespace"], value["parent_name"])

        owner, tablespace, comment = (F.col(f"{side}_{a}") for a in ("owner", "tablespace", "comment"))
        parent, last_parent = F.col(f"{side}_partition_of"), F.col(f"{other}_partition_of")
        alter_own = _text("ALTER TABLE", own)
        return [
            when_changed("owner", F.when(owner.isNotNull(), _text(alter_own, "OWNER TO", quote_ident(owner)))),
            when_changed(
                "tablespace",
                _text(alter_own, "SET TABLESPACE", quote_ident(F.coalesce(tablespace, F.lit("pg_default")))),
            ),
            when_changed(
                "partition_of",
                F.when(
                    last_parent.isNotNull(), _text("ALTER TABLE", partition(last_parent), "DETACH PARTITION", own)
                ),
            ),
            when_changed(
                "partition_of",
                F.when(
                    parent.isNotNull(),
                    _text("ALTER TABLE", partition(parent), "ATTACH PARTITION", own, parent["partition_bound"]),
                ),
            ),
            when_changed(
                "comment",
                _text("COMMENT ON TABLE", own, "IS", F.coalesce(_quoted_text(comment), F.lit("NULL"))),
            ),
        ]

    by_kind: list[tuple[str, list[Column], list[Column]]] = [
        ("create_table", create_table("new"), [drop_table]),
        ("drop_table", [drop_table], create_table("old")),
        ("rename_table", [rename_table("old_name", "new_name")], [rename_table("new_name", "old_name")]),
        # how a table is partitioned cannot be altered and yields no statement
        ("alter_table_attrs", attributes("new", "old"), attributes("old", "new")),
        ("add_column", [_text(alter_table, "ADD COLUMN", column_definition(column))], [drop_column]),
        ("drop_column", [drop_column], [_text(alter_table, "ADD COLUMN", column_definition(column))]),
        (
            "alter_column_type",
            [set_type(F.col("new_data_type"), F.col("new_collation"))],
            [set_type(old["data_type"], old["collation"])],
        ),
        ("set_column_default", [set_default(F.col("new_default"))], [set_default(old["default_expr"])]),
        ("set_column_nullability", [set_nullable(F.col("nullable"))], [set_nullable(old["nullable"])]),
        (
            "rename_column",
            [rename(_text(alter_table, "RENAME COLUMN"), "old_name", "new_name")],
            [rename(_text(alter_table, "RENAME COLUMN"), "new_name", "old_name")],
        ),
        (
            "replace_column",
            [drop_column, _text(alter_table, "ADD COLUMN", column_definition(column))],
            [drop_column, _text(alter_table, "ADD COLUMN", column_definition(old))],
        ),
        ("create_index", [index_definition(F.col("namespace"), F.col("index"))], [drop_index]),
        ("drop_index", [drop_index], [index_definition(F.col("namespace"), F.col("old_index"))]),
        (
            "replace_index",
            [drop_index, index_definition(F.col("namespace"), F.col("index"))],
            [drop_index, index_definition(F.col("namespace"), F.col("old_index"))],
        ),
        ("add_constraint", [add_constraint, validate], [drop_constraint]),
        ("drop_constraint", [drop_constraint], [add_constraint, validate]),
        ("create_schema", [create_schema], [drop_schema]),
        ("drop_schema", [drop_schema], [create_schema]),
        ("create_extension", [create_extension("new_version")], [drop_extension]),
        ("drop_extension", [drop_extension], [create_extension("old_version")]),
        (
            "alter_extension",
            [_text("ALTER EXTENSION", name, "UPDATE TO", _quoted_text(F.col("new_version")))],
            [_text("ALTER EXTENSION", name, "UPDATE TO", _quoted_text(F.col("old_version")))],
        ),
    ]
    forward = rollback = None
    for value, up, down in by_kind:
        forward = (F if forward is None else forward).when(kind == value, F.array_compact(F.array(*up)))
        rollback = (F if rollback is None else rollback).when(
            kind == value, F.array_compact(F.array(*down))
        )
    return forward, rollback


def render_statements(deltas: DataFrame) -> DataFrame:
    """Add ``forward`` and ``rollback`` statement arrays and ``transactional``.

    Index statements run concurrently and so outside of transactions.  New check
    and foreign key constraints are added unvalidated, then validated.
    """
    forward, rollback = _statements()
    return deltas.select(
        "*",
        forward.alias("forward"),
        rollback.alias("rollback"),
        (~F.col("kind").endswith("_index")).alias("transactional"),
    )


def statement_lines(rendered: DataFrame, order: list[str], direction: str = "forward") -> DataFrame:
    """One row per statement with its ``line`` (dense, from 1) in its pair's script and its ``barrier``.

    ``order`` must tell a pair's changes apart.  The barrier counts the lines up to
    here that cannot run in a transaction.
    """
    exploded = rendered.select(
        "pair_id", *order, "transactional", "risk", F.posexplode(direction).alias("_part", "statement")
    )
    outside = F.when(F.col("transactional"), F.lit(0)).otherwise(F.lit(1))
    return running(
        exploded, ["pair_id"], [*order, "_part"], {"line": ("sum", F.lit(1)), "barrier": ("sum", outside)}
    ).drop("_part")


def transaction_units(statements: DataFrame) -> DataFrame:
    """Runs of statements that can share a transaction.

    ``statements``: pair_id, line, barrier (see ``statement_lines``), transactional,
    risk.  Lines that cannot run in a transaction are units of their own; between
    them all lines form one unit, numbered by how many such lines came before.
    """
    return (
        statements.groupBy("pair_id", "barrier", "transactional")
        .agg(
            F.min("line").alias("start_line"),
            F.max("line").alias("end_line"),
            F.max(risk_rank(F.col("risk"))).alias("_rank"),
        )
        .select(
            "pair_id",
            "start_line",
            "end_line",
            "transactional",
            risk_label(F.col("_rank")).alias("max_risk"),
            F.when(F.col("transactional"), F.lit("shares one transaction"))
            .otherwise(F.lit("cannot run in a transaction"))
            .alias("reason"),
        )
    )


def lock_estimate(graded: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Lock mode, affected rows and severity of each change.

    ``row_counts``: pair_id, namespace, table_name, row_count.  Tables without a
    count have a null one.
    """
    kind = F.col("kind")
    foreign_key = F.coalesce(F.col("constraint.kind") == "foreign_key", F.lit(False))
    lock = (
        F.when(kind.endswith("_index"), F.lit("SHARE UPDATE EXCLUSIVE"))
        .when((kind == "add_constraint") & foreign_key, F.lit("SHARE ROW EXCLUSIVE"))
        .when(
            (kind == "alter_table_attrs") & (F.size(F.array_except("changed", F.array(F.lit("comment")))) == 0),
            F.lit("SHARE UPDATE EXCLUSIVE"),
        )
        .when(F.col("object_kind").isin("schema", "extension"), F.lit("NONE"))
        .otherwise(F.lit("ACCESS EXCLUSIVE"))
    )
    severity = (
        F.when(F.col("risk") == "SAFE", F.lit("ok"))
        .when(F.col("risk") == "WARNING", F.lit(""))
        .when(F.col("risk") == "DANGEROUS", F.lit("warn"))
        .otherwise(F.lit("err"))
    )
    located = graded.withColumn(
        "table_name",
        F.coalesce(
            "parent_name",
            F.coalesce(F.col("index"), F.col("old_index"))["table_name"],
            F.when(F.col("object_kind") == "table", F.col("name")),
        ),
    )
    return located.join(row_counts, ["pair_id", "namespace", "table_name"], "left").select(
        "pair_id",
        "namespace",
        "table_name",
        "name",
        "kind",
        lock.alias("lock_mode"),
        F.col("row_count"),
        severity.alias("severity"),
    )
