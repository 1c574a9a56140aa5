"""A small architecture in two versions, with what is known about it: registry rows, facts, and the text of its document.

Version 2 follows from version 1 by five edits (`second`); the triples of a version follow from its tables (`triples`).
"""

from __future__ import annotations

import copy

V1, V2 = "1.0.0", "1.1.0"

# Components (id, name, type, layer).
COMPONENTS = """
C-01 DoorControlSWC SWC Application
C-02 WindowLiftSWC SWC Application
C-03 MirrorAdjustSWC SWC Application
C-04 LightControlSWC SWC Application
C-05 SeatAdjustSWC SWC Application
C-06 ClimateInterfaceSWC SWC Application
C-07 KeylessEntrySWC SWC Application
C-08 BodyControlSWC SWC Application
C-09 VehicleModeSWC SWC Application
C-10 SpeedProviderSWC SWC Application
C-11 RteAdapter RTE RTE
C-12 Com BSW Service
C-13 PduR BSW Service
C-14 CanIf BSW Service
C-15 CanDriver BSW ECU-Abstraction
C-16 CanSm BSW Service
C-17 NvM BSW Service
C-18 EcuM BSW Service
C-19 DiagManager BSW Service
C-20 IoHwAb ECU-Abstraction ECU-Abstraction
"""
# Interfaces (id, name, kind, provider, consumers).
INTERFACES = """
IF-01 DoorStatusIF S-R C-01 C-08
IF-02 DoorCommandIF C-S C-08 C-01
IF-03 WindowStatusIF S-R C-02 C-08
IF-04 WindowCommandIF C-S C-08 C-02
IF-05 MirrorStatusIF S-R C-03 C-08
IF-06 MirrorCommandIF C-S C-08 C-03
IF-07 InteriorLightIF S-R C-04 C-08
IF-08 SeatStatusIF S-R C-05 C-08
IF-09 SeatCommandIF C-S C-08 C-05
IF-10 ClimateRequestIF C-S C-06 C-08
IF-11 KeyAuthIF S-R C-07 C-08
IF-12 VehicleModeIF S-R C-09 C-08,C-01,C-02
IF-13 VehicleSpeedIF S-R C-10 C-01,C-02
IF-14 RteComIF S-R C-11 C-12
IF-15 RtePduIF C-S C-12 C-11
IF-16 ComPduRIF C-S C-12 C-13
IF-17 PduCanIfIF C-S C-13 C-14
IF-18 CanIfDriverIF C-S C-14 C-15
IF-19 CanSmControlIF C-S C-16 C-15
IF-20 NvBlockIF C-S C-17 C-02,C-05
IF-21 EcuModeIF S-R C-18 C-16,C-12
IF-22 DiagRequestIF C-S C-19 C-11
IF-23 IoHwDoorIF S-R C-20 C-01,C-02
IF-24 IoHwMirrorSeatIF S-R C-20 C-03,C-05
IF-25 IoHwLightIF S-R C-20 C-04
"""
# Signals (id, name, data type, unit, interface).
SIGNALS = """
SG-001 DoorStatus uint8 - IF-01
SG-002 ChildLockActive boolean - IF-01
SG-003 DoorLockRequest uint8 - IF-02
SG-004 WindowPosition uint8 % IF-03
SG-005 AntiPinchTriggered boolean - IF-03
SG-006 WindowLiftCommand sint8 - IF-04
SG-007 MirrorFoldState boolean - IF-05
SG-008 MirrorPosition uint8 deg IF-05
SG-009 MirrorAdjustCommand uint8 - IF-06
SG-010 InteriorLightLevel uint8 % IF-07
SG-011 SeatPosition uint16 mm IF-08
SG-012 SeatMemorySlot uint8 - IF-08
SG-013 SeatAdjustCommand sint8 - IF-09
SG-014 BlowerLevelRequest uint8 % IF-10
SG-015 KeyAuthStatus uint8 - IF-11
SG-016 VehicleMode uint8 - IF-12
SG-017 CrashSignal boolean - IF-12
SG-018 VehicleSpeed uint16 km/h IF-13
SG-019 SpeedValidity boolean - IF-13
SG-020 ComSignalBatch1 uint8[8] - IF-14
SG-021 ComSignalBatch2 uint8[8] - IF-15
SG-022 PduPayload uint8[64] - IF-16
SG-023 CanFrame uint8[8] - IF-17
SG-024 CanFrameRaw uint8[8] - IF-18
SG-025 CanChannelState uint8 - IF-19
SG-026 NvBlockStatus uint8 - IF-20
SG-027 EcuModeState uint8 - IF-21
SG-028 DiagRequestPayload uint8[255] - IF-22
SG-029 DoorSwitchRaw uint8 - IF-23
SG-030 WindowMotorCurrent uint16 mA IF-23
SG-031 MirrorMotorFeedback uint16 mA IF-24
SG-032 SeatMotorFeedback uint16 mA IF-24
SG-033 LightSwitchRaw uint8 - IF-25
SG-034 AmbientLightFeedback uint8 % IF-25
"""
# Dependencies (id, source, target, relationship).
DEPENDENCIES = """
DEP-01 C-01 C-08 requires
DEP-02 C-02 C-08 requires
DEP-03 C-03 C-08 requires
DEP-04 C-05 C-08 requires
DEP-05 C-06 C-08 requires
DEP-06 C-08 C-09 requires
DEP-07 C-08 C-10 requires
DEP-08 C-02 C-10 requires
DEP-09 C-01 C-07 requires
DEP-10 C-11 C-12 depends_on
DEP-11 C-12 C-13 depends_on
DEP-12 C-13 C-14 depends_on
DEP-13 C-14 C-15 depends_on
DEP-14 C-16 C-15 requires
DEP-15 C-02 C-17 requires
DEP-16 C-05 C-17 requires
DEP-17 C-18 C-16 requires
DEP-18 C-18 C-12 requires
DEP-19 C-19 C-11 requires
DEP-20 C-01 C-20 requires
DEP-21 C-02 C-20 requires
DEP-22 C-03 C-20 requires
DEP-23 C-04 C-20 requires
DEP-24 C-05 C-20 requires
"""
# Flows (id, name, steps).
FLOWS = {
    "FL-1": ("Door Lock Actuation", "C-20 C-01 C-08 C-11 C-12 C-13 C-14 C-15"),
    "FL-2": ("One-Touch Window Lift with Anti-Pinch", "C-20 C-02 C-10 C-08 C-11 C-12 C-13 C-14 C-15"),
    "FL-3": ("Keyless Unlock", "C-07 C-08 C-01 C-20"),
    "FL-4": ("Seat Memory Recall", "C-17 C-05 C-08 C-20"),
    "FL-5": ("Bus-Off Recovery", "C-15 C-16 C-18"),
}


def _rows(table: str, names: str) -> list[dict]:
    return [dict(zip(names.split(), line.split(" "))) for line in table.strip().splitlines()]


def first() -> dict:
    m = {
        "components": _rows(COMPONENTS, "id name type layer"),
        "interfaces": _rows(INTERFACES, "id name kind provider consumers"),
        "signals": _rows(SIGNALS, "id name datatype unit interface"),
        "dependencies": _rows(DEPENDENCIES, "id source target relationship"),
        "flows": [{"id": k, "name": n, "steps": s.split()} for k, (n, s) in FLOWS.items()],
    }
    for i in m["interfaces"]:
        i["consumers"] = i["consumers"].split(",")
    return _with_ports(m)


def _with_ports(m: dict) -> dict:
    """A port for each provider and then each consumer of an interface, numbered through."""
    held = [(c, i["id"], d) for i in m["interfaces"] for c, d in [(i["provider"], "provides"), *((c, "requires") for c in i["consumers"])]]
    m["ports"] = [{"id": f"P-{n:03d}", "component": c, "interface": i, "direction": d} for n, (c, i, d) in enumerate(held, 1)]
    return m


def second() -> dict:
    """The second version: C-05 loses all it touches, DEP-19 and SG-015 go, C-09 is renamed, IF-13 changes its provider, IF-03
    gains a consumer."""
    m = copy.deepcopy(first())
    for i in m["interfaces"]:
        i["consumers"] = [c for c in i["consumers"] if c != "C-05"]
    m["interfaces"] = [i for i in m["interfaces"] if i["provider"] != "C-05" and i["consumers"]]
    left = {i["id"] for i in m["interfaces"]}
    m["signals"] = [s for s in m["signals"] if s["interface"] in left and s["id"] != "SG-015"]
    m["dependencies"] = [d for d in m["dependencies"] if "C-05" not in (d["source"], d["target"]) and d["id"] != "DEP-19"]
    m["flows"] = [f for f in m["flows"] if f["id"] != "FL-4"]
    for c in m["components"]:
        c["name"] = "VehicleModeMgrSWC" if c["id"] == "C-09" else c["name"]
    for i in m["interfaces"]:
        i["provider"] = "C-08" if i["id"] == "IF-13" else i["provider"]
        i["consumers"] += ["C-04"] if i["id"] == "IF-03" else []
    return _with_ports(m)


KINDS = {"components": "component", "interfaces": "interface", "signals": "signal", "dependencies": "dependency", "flows": "functional_flow", "ports": "port"}


def entities(m: dict) -> list[tuple[str, str, str]]:
    """(entity_key, entity_type, name)."""
    return [(f"{kind}:{r['id']}", kind, r.get("name", "")) for table, kind in KINDS.items() for r in m[table]]


def triples(m: dict) -> set[tuple[str, str, str]]:
    out = {(f"component:{i['provider']}", "provides", f"interface:{i['id']}") for i in m["interfaces"]}
    out |= {(f"component:{c}", "requires", f"interface:{i['id']}") for i in m["interfaces"] for c in i["consumers"]}
    out |= {(f"interface:{s['interface']}", "carries", f"signal:{s['id']}") for s in m["signals"]}
    out |= {(f"component:{d['source']}", "depends_on", f"component:{d['target']}") for d in m["dependencies"]}
    out |= {(f"port:{p['id']}", "implements", f"interface:{p['interface']}") for p in m["ports"]}
    return out | {(f"component:{s}", "participates_in", f"functional_flow:{f['id']}") for f in m["flows"] for s in f["steps"]}


def facts(m: dict) -> list[tuple[str, str, str, str, str, float]]:
    """(fact_key, subject, predicate, object, object_value, confidence)."""
    return sorted((f"{s}|{p}|{o}|", s, p, o, "", 0.9) for s, p, o in triples(m))


ENTITY_SCHEMA = "entity_key string, entity_type string, name string"
FACT_SCHEMA = "fact_key string, subject string, predicate string, object string, object_value string, confidence double"


def frames(spark, m: dict):
    return spark.createDataFrame(facts(m), FACT_SCHEMA), spark.createDataFrame(entities(m), ENTITY_SCHEMA)


# --- the document: page lines and tables, in the shapes that extraction knows --------------------------------------------


def document(m: dict, version: str) -> dict:
    """A bundle: document_name, version, sha256, pages (page_no, lines), tables (page_no, table_index, headers, rows)."""
    name = {c["id"]: c["name"] for c in m["components"]}
    iface = {i["id"]: i for i in m["interfaces"]}
    pages: list[dict] = []
    tables: list[dict] = []

    def page(lines, *here):
        pages.append({"page_no": len(pages) + 1, "lines": [*lines, f"Page {len(pages) + 1}"]})
        for k, (headers, rows) in enumerate(here):
            tables.append({"page_no": len(pages), "table_index": k, "headers": headers, "rows": rows})
            pages[-1]["lines"] += headers

    page(["High-Level Design", f"Version {version}"])
    page(["1 Introduction", "This document describes the body controller of a vehicle."])
    page(["2 Components", "All components are listed here."], (["ID", "Component", "Type", "Layer", "Description"], [[c["id"], c["name"], c["type"], c["layer"], f"Component {c['name']} of the {c['layer']} layer"] for c in m["components"]]))
    for k, c in enumerate(m["components"], 1):
        lines = [f"3.{k} Component {c['id']}: {c['name']}", f"({c['type']}, {c['layer']} layer) handles its part."]
        own = [p for p in m["ports"] if p["component"] == c["id"]]
        here = [(["Port", "Direction", "Interface", "Kind"], [[p["id"], p["direction"], iface[p["interface"]]["name"], iface[p["interface"]]["kind"]] for p in own])] if own else []
        page(lines, *here)
    for k, i in enumerate(m["interfaces"], 1):
        users = ", ".join(f"{c} ({name[c]})" for c in i["consumers"])
        rows = [[s["name"], s["datatype"], s["unit"]] for s in m["signals"] if s["interface"] == i["id"]]
        page([f"4.{k} Interface {i['name']} ({i['id']})", f"It is a {i['kind']} interface. Provider: {i['provider']} ({name[i['provider']]}). Consumers: {users}."], *([(["Signal", "Datatype", "Unit"], rows)] if rows else []))
    page(["5 Signals", "All signals are listed here."], (["Signal ID", "Signal", "Datatype", "Unit", "Interface"], [[s["id"], s["name"], s["datatype"], s["unit"], iface[s["interface"]]["name"]] for s in m["signals"]]))
    page(["6 Dependencies", "All dependencies are listed here."], (["Dep. ID", "Source", "Target", "Type"], [[d["id"], f"{d['source']} ({name[d['source']]})", f"{d['target']} ({name[d['target']]})", d["relationship"]] for d in m["dependencies"]]))
    for k, f in enumerate(m["flows"], 1):
        page([f"7.{k} {f['name']} ({f['id']})", "Trigger: a request. Flow: " + " then ".join(f"{s} ({name[s]})" for s in f["steps"]) + "."])
    return {"document_name": f"design_v{version}", "version": version, "sha256": ("0" if version == V1 else "1") * 64, "pages": pages, "tables": tables}
