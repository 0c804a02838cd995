"""What an event does to an employee, the contract and the memo, in the order of event time."""

from __future__ import annotations

from .ordered import SECOND, Fold

HIRE, EXIT, CANCEL, END = "alta", "retiro", "cancela", "termina"
EMPLOYEES, CONTRACTS, MEMOS = "employees", "contracts", "memoranda"
DAY = 24 * 60 * 60 * SECOND


def employment(keep_days: int | None = None) -> Fold:
    """alta hires (id is the contract's), or hires again: the exit goes, the first hire stays. retiro ends the employment,
    termina the open contract. cancela ends both by a memo (id is the memo's), which is archived whatever else holds.

    An exit needs someone active, and only an open contract can end: with the event's date, and once. Every row has the
    event's time as its stamp. keep_days: the state of someone inactive goes after so many days without an event; whoever
    comes back later is hired as if for the first time.

    Rows: table_name, record_id, status, reason, since (first hire), ended, stamp; times in microseconds.
    """

    def step(state: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        at, number, kind = event
        status, hired, contract, _ = state or ("", None, None, None)
        rows: list[tuple] = []
        if kind == HIRE and status != "activo":
            rows.append((EMPLOYEES, None, "activo", "contratado" if hired is None else "reingreso", hired or at, None, at))
            rows.append((CONTRACTS, number, "vigente", None, at, None, at))
            status, hired, contract = "activo", hired or at, number
        elif kind in (EXIT, CANCEL) and status == "activo":
            rows.append((EMPLOYEES, None, "inactivo", "despido_justificado" if kind == CANCEL else "retiro", hired, at, at))
            status = "inactivo"
        if kind in (CANCEL, END) and contract is not None:
            rows.append((CONTRACTS, contract, "terminado", kind, None, at, at))
            contract = None
        if kind == CANCEL:
            rows.append((MEMOS, number, "archivado", None, None, None, at))
        return (status, hired, contract, at) if status else None, rows

    def deadline(state: tuple | None) -> int | None:
        return state[3] + keep_days * DAY if keep_days is not None and state and state[0] == "inactivo" else None

    return Fold(
        event="at long, id long, event string",
        state="status string, hired long, contract long, last long",
        row="table_name string, record_id long, status string, reason string, since long, ended long, stamp long",
        step=step,
        deadline=deadline,
    )
