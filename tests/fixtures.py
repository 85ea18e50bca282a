"""Test inputs (FIXTURES.md): the three-row template catalog and a hostile
catalog, written as real CSV files with the export's quoted multi-line
headers."""

from __future__ import annotations

import csv
import os

SALES = '" Net Sales $ \n{y} "'
QTY = '" Net Sales Q\n{y} "'

# the template catalog
TEMPLATE = {
    "WorkRef": ["w1", "w2", "w3"],
    "BookType": ["Monograph", "Textbook", "Reference"],
    "Discipline": ["Economics", "History", "Literature"],
    "JJ: Reporting Type 2": ["a. Print", "b. eBook", "a. Print"],
    "FiscalYearOfPublication": [2020, 2021, 2019],
    "PubDate": ["2020-01-15", "2021-03-22", "2019-11-08"],
    "Imprint": ["University Press", "Academic Press", "Scholarly Press"],
    SALES.format(y=2022): [1500, 2500, 800],
    SALES.format(y=2023): [1800, 2800, 950],
    SALES.format(y=2024): [2000, 3000, 1200],
    QTY.format(y=2022): [25, 50, 15],
    QTY.format(y=2023): [30, 55, 18],
    QTY.format(y=2024): [35, 60, 22],
}


def write_rows(path: str, header: list[str], rows: list[list]) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.writer(f, quoting=csv.QUOTE_MINIMAL)
        w.writerow(header)
        for r in rows:
            w.writerow(["" if v is None else v for v in r])
    return path


def write_template(path: str) -> str:
    header = list(TEMPLATE)
    rows = [[TEMPLATE[h][i] for h in header] for i in range(3)]
    return write_rows(path, header, rows)
