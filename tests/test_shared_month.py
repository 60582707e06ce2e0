"""Queries that read the monthly table for their matches and again for a panel build it once."""

import pytest

from kwhlens.plans import q_effects as QE
from kwhlens.plans import q_matching as QM


class Frame:
    columns = ()

    def where(self, _):
        return self


@pytest.mark.parametrize("module, query", [
    (QM, lambda: QM._validation(None, "")), (QM, lambda: QM._valid_dim(None, "")),
    (QE, lambda: QE.panel_m1(None, "")), (QE, lambda: QE.panel_m2(None, "", None)), (QE, lambda: QE.panel_m3(None, "")),
    (QE, lambda: QE._did_by_price(None, ""))])
def test_one_monthly_table(monkeypatch, module, query):
    built = []

    def month(*_):
        built.append(Frame())
        return built[-1]

    monkeypatch.setattr(QM, "month_result", month)
    monkeypatch.setattr(QE, "month_result", month)
    read = []
    monkeypatch.setattr(QM.R, "base_panel", lambda mr, **kw: read.append(mr))
    monkeypatch.setattr(QM.R, "build_risk_set_rows", lambda *a, **kw: None)
    for name in ("run_summary_matching", "run_calendar_matching"):
        monkeypatch.setattr(QM.L, name, lambda *a, **kw: {"matches": "matches"})
    for name in ("validation_balance", "calendar_valid_dim_distribution"):
        monkeypatch.setattr(QM.B, name, lambda *a, **kw: None)
    for name in ("unweighted_panel", "pair_panel", "weighted_panel"):
        monkeypatch.setattr(QE.M, name, lambda matches, mr, *a: read.append(mr))
    monkeypatch.setattr(QE, "prepare_price_panel", lambda mr, *a: mr)
    monkeypatch.setattr(QE.D, "price_panels", lambda matches, mr: read.append(mr))
    monkeypatch.setattr(QE.D, "fit_basic_did", lambda *a, **kw: None)
    query()
    assert len(built) == 1 and len(read) == 2 and all(x is built[0] for x in read)
