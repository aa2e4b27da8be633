"""S3: seed-shaped rows.

Fixed values: the numbers, dates, times and invoice numbers equal those of the
reference's seed rows, because the golden answers (FIXTURES.md section 1.3) were
computed from them; names and telephone numbers are invented.
"""

import datetime as dt

from tillspark import schemas
from tillspark.sources.tables import literal_table

SEED_AS_OF = dt.date(2026, 6, 12)

# fmt: off
ROWS = {
    "categories": [  # id, name, desc
        (1, "Category 1", None),
        (2, "Category 2", None),
        (3, "Category 3", None),
        (4, "Category 4", None),
        (5, "Category 5", None),
        (6, "Category 6", None),
        (7, "Category 7", None),
    ],
    "customers": [  # id, name, phone, email, address, created_at
        (1, "Customer 1", "08120000001", None, None, None),
        (2, "Customer 2", "08120000002", None, None, None),
        (3, "Customer 3", "08120000003", None, None, None),
        (4, "Customer 4", "08120000004", None, None, None),
    ],
    "discount_rules": [  # id, name, type, value, min_purchase, max_discount, is_active, start_date, end_date
        (1, "Rule 1", "percent", 5, 100000, None, True, None, None),
        (2, "Rule 2", "percent", 10, 200000, None, True, None, None),
        (3, "Rule 3", "flat", 10000, 50000, None, True, None, None),
        (4, "Rule 4", "flat", 25000, 100000, None, True, None, None),
    ],
    "products": [  # id, name, category_id, barcode, cost, price, stock, min_stock, unit, status
        (1, "Product 1", 1, None, 2500, 3500, 44, 10, "pcs", "TERSEDIA"),
        (2, "Product 2", 1, None, 3000, 4500, 35, 10, "pcs", "TERSEDIA"),
        (3, "Product 3", 3, None, 2800, 3500, 100, 20, "pcs", "TERSEDIA"),
        (4, "Product 4", 2, None, 8000, 10000, 24, 5, "pcs", "TERSEDIA"),
        (5, "Product 5", 4, None, 3500, 5000, 30, 5, "pcs", "TERSEDIA"),
        (6, "Product 6", 5, None, 22000, 25000, 41, 10, "pcs", "TERSEDIA"),
        (7, "Product 7", 3, None, 12500, 15000, 14, 5, "pcs", "TERSEDIA"),
        (8, "Product 8", 3, None, 13000, 15500, 20, 5, "pcs", "TERSEDIA"),
        (9, "Product 9", 3, None, 14000, 17000, 13, 5, "pcs", "TERSEDIA"),
        (10, "Product 10", 1, None, 5500, 7000, 24, 6, "pcs", "TERSEDIA"),
        (11, "Product 11", 4, None, 15000, 20000, 8, 3, "pcs", "TERSEDIA"),
        (12, "Product 12", 4, None, 8500, 11000, 20, 4, "pcs", "TERSEDIA"),
        (13, "Product 13", 1, None, 4500, 5500, 32, 21, "pcs", "TERSEDIA"),
        (786524, "Product 786524", 7, None, 150000, 150000, 4, 1, "pcs", "TERSEDIA"),
        (786525, "Product 786525", 6, None, 15600, 16500, 100, 1, "pcs", "TERSEDIA"),
        (786526, "Product 786526", 7, None, 35000, 35500, 1, 1, "pcs", "TERSEDIA"),
    ],
    "transactions": [  # id, invoice_no, date, time, cashier_id, customer_id, subtotal, discount, total, paid, change, status, discount_type, discount_value, discount_amount
        (1, "INV-0001", dt.date(2026, 6, 11), "09:30:00", 1, 1, 35000, 0, 35000, 50000, 15000, "completed", "flat", 0, 0),
        (2, "INV-0002", dt.date(2026, 6, 11), "10:15:00", 2, None, 22500, 0, 22500, 30000, 7500, "completed", "flat", 0, 0),
        (3, "INV-0003", dt.date(2026, 6, 10), "14:20:00", 1, 2, 87000, 5000, 82000, 100000, 18000, "completed", "flat", 0, 0),
        (4, "INV-0004", dt.date(2026, 6, 9), "11:45:00", 2, 3, 15000, 0, 15000, 20000, 5000, "completed", "flat", 0, 0),
        (5, "INV-0005", dt.date(2026, 6, 8), "16:10:00", 1, None, 42000, 2000, 40000, 50000, 10000, "completed", "flat", 0, 0),
        (6, "INV-1781160401248", dt.date(2026, 6, 11), "13:46:00", 1, None, 20000, 0, 20000, 25000, 5000, "completed", "flat", 0, 0),
        (7, "INV-1781160446582", dt.date(2026, 6, 11), "13:47:00", 1, None, 3500, 0, 3500, 5000, 1500, "completed", "flat", 0, 0),
        (8, "INV-1781161627352", dt.date(2026, 6, 11), "14:07:00", 1, None, 60000, 10000, 50000, 60000, 10000, "completed", "flat", 10000, 10000),
        (9, "INV-1781161664822", dt.date(2026, 6, 11), "14:07:00", 1, None, 100000, 5000, 95000, 100000, 5000, "completed", "percent", 5, 5000),
        (10, "INV-1781174748384", dt.date(2026, 6, 11), "17:45:00", 1, None, 50000, 10000, 40000, 50000, 10000, "completed", "flat", 10000, 10000),
        (11, "INV-1781199734092", dt.date(2026, 6, 11), "00:42:00", 1, None, 3500, 0, 3500, 5000, 1500, "completed", "flat", 0, 0),
        (12, "INV-1781200461771", dt.date(2026, 6, 11), "00:54:00", 1, None, 3500, 0, 3500, 5000, 1500, "completed", "flat", 0, 0),
        (13, "INV-1781200834014", dt.date(2026, 6, 11), "01:00:00", 1, None, 4500, 0, 4500, 5000, 500, "completed", "flat", 0, 0),
        (14, "INV-1781255324032", dt.date(2026, 6, 12), "16:08:00", 1, None, 150000, 7500, 142500, 150000, 7500, "completed", "percent", 5, 0),
        (15, "INV-1781256861223", dt.date(2026, 6, 12), "16:34:00", 1, 4, 3500, 0, 3500, 5000, 1500, "completed", "flat", 0, 0),
        (16, "INV-1781258892328", dt.date(2026, 6, 12), "17:08:00", 4, None, 75000, 10000, 65000, 100000, 35000, "completed", "flat", 10000, 0),
    ],
    "tx_details": [  # tx_id, product_id, product_name, qty, price, subtotal
        (1, 1, "Product 1", 2, 3500, 7000),
        (1, 3, "Product 3", 8, 3500, 28000),
        (2, 2, "Product 2", 3, 4500, 13500),
        (2, 5, "Product 5", 2, 4500, 9000),
        (3, 6, "Product 6", 2, 25000, 50000),
        (3, 10, "Product 10", 2, 7000, 14000),
        (3, 11, "Product 11", 1, 20000, 20000),
        (4, 4, "Product 4", 1, 10000, 10000),
        (4, 8, "Product 8", 1, 5000, 5000),
        (5, 7, "Product 7", 2, 15000, 30000),
        (5, 12, "Product 12", 1, 11000, 11000),
        (6, 11, "Product 11", 1, 20000, 20000),
        (7, 1, "Product 1", 1, 3500, 3500),
        (8, 11, "Product 11", 3, 20000, 60000),
        (9, 6, "Product 6", 4, 25000, 100000),
        (10, 6, "Product 6", 2, 25000, 50000),
        (11, 1, "Product 1", 1, 3500, 3500),
        (14, 786524, "Product 786524", 1, 150000, 150000),
        (15, 1, "Product 1", 1, 3500, 3500),
        (16, 6, "Product 6", 3, 25000, 75000),
    ],
    "users": [  # id, name, username, password_digest, role, status, created_at
        (1, "Cashier 1", "cashier1", None, "admin", "active", None),
        (2, "Cashier 2", "cashier2", None, "kasir", "active", None),
        (3, "Cashier 3", "cashier3", None, "kasir", "inactive", None),
        (4, "Cashier 4", "cashier4", None, "kasir", "active", None),
    ],
}
# fmt: on


def fixture(spark, table):
    """The seed-shaped rows of ``table`` with its declared schema."""
    return literal_table(spark, ROWS[table], schemas.TABLES[table])


def seed_model(spark):
    return {t: fixture(spark, t) for t in schemas.TABLES}
