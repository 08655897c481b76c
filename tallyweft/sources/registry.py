"""The public datasets that the adapters read, and the state of their files on disk (nothing is downloaded)."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from pathlib import Path

# Names, roles, licences, places and files as their publishers give them.
SOURCES = {
    "elliptic": ("graph benchmark of transactions over 49 time steps", "CC BY-NC-SA 4.0", "kaggle datasets download -d ellipticco/elliptic-data-set"),
    "elliptic_pp": ("accounts as actors", "CC BY-NC-SA 4.0", "the actor-level files named in the README of git-disl/EllipticPlusPlus on GitHub"),
    "ibm_aml": ("synthetic transfers between banks", "see the listing", "kaggle datasets download -d ealtman2019/ibm-transactions-for-anti-money-laundering-aml"),
    "paysim": ("6.3 million mobile-money transactions, for tests of scale", "CC0", "kaggle datasets download -d ealaxi/paysim1"),
    "baf": ("account applications with protected attributes", "CC BY-NC-SA 4.0", "kaggle datasets download -d sgpjesus/bank-account-fraud-dataset-neurips-2022"),
    "ieee_cis": ("card transactions, a tabular baseline", "competition rules", "kaggle competitions download -c ieee-fraud-detection"),
}
FILES = [
    ("elliptic", "elliptic_txs_features.csv", "no header: txId, time step, 165 features"),
    ("elliptic", "elliptic_txs_classes.csv", "txId, class: 1 illicit, 2 licit, unknown"),
    ("elliptic", "elliptic_txs_edgelist.csv", "txId1, txId2"),
    ("elliptic_pp", "wallets_features_classes_combined.csv", "address, features, class: 1 illicit, 2 licit, 3 unknown"),
    ("elliptic_pp", "AddrAddr_edgelist.csv", "input_address, output_address"),
    ("ibm_aml", "HI-Small_Trans.csv", "Timestamp, From Bank, Account, To Bank, Account, amounts and currencies, Payment Format, Is Laundering"),
    ("paysim", "PS_20174392719_1491204439457_log.csv", "step, type, amount, nameOrig, balances, nameDest, balances, isFraud, isFlaggedFraud"),
    ("baf", "Base.csv", "fraud_bool and about 30 features"),
    ("ieee_cis", "train_transaction.csv", "TransactionID, isFraud, TransactionDT, TransactionAmt, ProductCD, cards, addresses"),
    ("ieee_cis", "train_identity.csv", "TransactionID, device and identity columns"),
]


class ChecksumError(ValueError):
    """A file is there with other bytes than its pinned digest."""


def expected(name: str) -> dict[str, str]:
    """What each file of a dataset holds, by file name."""
    if name not in SOURCES:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(SOURCES)}")
    return {file: holds for of, file, holds in FILES if of == name}


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def on_disk(names: Mapping[str, object] | list[str], folder: str, pins: Mapping[str, str] | None = None) -> dict[str, str]:
    """State of each file: ``absent``, ``present``, or ``verified`` where a digest is pinned; other bytes than pinned raise."""
    pins, states, other = pins or {}, {}, []
    for name in names:
        path = Path(folder) / name
        states[name] = "present" if path.exists() else "absent"
        if states[name] == "present" and name in pins:
            states[name] = "verified"
            other += [name] * (_digest(path) != pins[name])
    if other:
        raise ChecksumError(f"not the pinned bytes: {other}")
    return states


def how_to_get(name: str, folder: str) -> str:
    """Where a dataset comes from and which files belong into the folder."""
    role, licence, place = SOURCES[name]
    token = " (needs ~/.kaggle/kaggle.json, or KAGGLE_USERNAME and KAGGLE_KEY)" if place.startswith("kaggle ") else ""
    return "\n".join([f"{name}: {role}; licence: {licence}", f"Get it with: {place}{token}", f"Put into {folder}:", *(f"- {file} ({holds})" for file, holds in expected(name).items())])
