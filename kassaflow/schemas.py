"""Fixed column contracts of the five source tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Column order, kept columns and nullable columns of each table.
COLUMNS = {
    "transactions": ["transaction_id", "store_id", "payment_method_id", "voucher_id", "user_id", "original_amount", "discount_applied", "final_amount", "created_at"],
    "transaction_items": ["transaction_id", "item_id", "quantity", "unit_price", "subtotal", "created_at"],
    "users": ["user_id", "gender", "birthdate", "registered_at"],
    "stores": ["store_id", "store_name", "street", "postal_code", "city", "state", "latitude", "longitude"],
    "menu_items": ["item_id", "item_name", "category", "price", "is_seasonal", "available_from", "available_to"],
}
KEPT = {
    "transactions": ["transaction_id", "final_amount", "created_at", "store_id", "user_id"],
    "transaction_items": ["item_id", "quantity", "subtotal", "created_at"],
    "users": ["user_id", "birthdate"],
    "stores": ["store_id", "store_name"],
    "menu_items": ["item_id", "item_name"],
}
NULLABLE_KEPT = {"transactions": ["user_id"]}
#: Dimension tables come first, as consumers need them before the facts.
LOAD_ORDER = ["menu_items", "stores", "users", "transactions", "transaction_items"]

_TYPES = {
    "original_amount": T.DecimalType(18, 2),
    "discount_applied": T.DecimalType(18, 2),
    "final_amount": T.DecimalType(18, 2),
    "unit_price": T.DecimalType(18, 2),
    "subtotal": T.DecimalType(18, 2),
    "price": T.DecimalType(18, 2),
    "quantity": T.LongType(),
    "created_at": T.TimestampType(),
    "registered_at": T.TimestampType(),
    "latitude": T.DoubleType(),
    "longitude": T.DoubleType(),
}


def typed(column: str) -> T.DataType:
    """The Spark type of a source column; ids, names and dates stay text."""
    return _TYPES.get(column, T.StringType())


def text_schema(table: str) -> T.StructType:
    """The table as it stands in a delimited file: every column text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS[table]])


@dataclass(frozen=True)
class TableSpec:
    """What a cleaner keeps of a table.

    ``nullable`` must be a subset of ``want``; ``want`` of ``have``.
    """

    name: str
    have: tuple[str, ...]
    want: tuple[str, ...]
    nullable: tuple[str, ...] = ()
    whole_number_ids: tuple[str, ...] = field(default=("user_id",))

    def __post_init__(self) -> None:
        if missing := [c for c in self.want if c not in self.have]:
            raise ValueError(f"{self.name}: {missing} are not columns of the input")
        if missing := [c for c in self.nullable if c not in self.want]:
            raise ValueError(f"{self.name}: {missing} may be empty but aren't kept")

    @property
    def required(self) -> list[str]:
        return [c for c in self.want if c not in self.nullable]


def spec(table: str, anonymous: bool = True) -> TableSpec:
    """The spec of a source table; ``anonymous=False`` drops rows without user."""
    nullable = NULLABLE_KEPT.get(table, []) if anonymous else []
    return TableSpec(table, tuple(COLUMNS[table]), tuple(KEPT[table]), tuple(nullable))
