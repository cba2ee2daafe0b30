"""Names of the network vocabulary, in one place.

Fixed values: classes, properties, criteria and the sensor catalogue.
"""

from __future__ import annotations

NS = "http://example.org/net#"
NODE_CLASSES = {"dead_end": "DeadEnd", "bend": "Bend", "junction": "Junction"}
CRITERIA = {"f1_topology": "TopologyCriterion", "f2_elevation": "ElevationCriterion", "f3_pressure": "PressureCriterion", "f4_demand": "DemandCriterion"}
#: name: class, label, observed property, pin, interface, unit
SENSORS = {
    "pH": ("PHSensor", "DFRobot Gravity Analog pH v2", "pH", "A0", "AnalogInterface", "PH"),
    "TDS": ("TDSSensor", "DFRobot Gravity Analog TDS", "totalDissolvedSolids", "A1", "AnalogInterface", "PPM"),
    "DO": ("DOSensor", "DFRobot Gravity Analog Dissolved Oxygen", "dissolvedOxygen", "A2", "AnalogInterface", "MilliGM-PER-L"),
    "ORP": ("ORPSensor", "Analog ORP meter, Pt-ring electrode", "oxidationReductionPotential", "A3", "AnalogInterface", "MilliV"),
    "Temperature": ("TemperatureSensor", "DS18B20 1-Wire temperature probe", "waterTemperature", "D2", "OneWireInterface", "DEG_C"),
    "Turbidity": ("TurbiditySensor", "Analog turbidity sensor", "turbidity", "A4", "AnalogInterface", "NTU"),
    "Pressure": ("PressureSensor", "Piezoresistive pressure transducer", "pressure", "A5", "AnalogInterface", "M-H2O"),
    "Flow": ("FlowSensor", "Hall-effect flow meter", "flowRate", "D3", "PulseInterface", "L-PER-SEC"),
}
SUITE = ("pH", "TDS", "ORP", "DO", "Temperature")
COMPENSATED = ("pH", "TDS", "DO")
#: subclass: superclass
SUBCLASSES = {
    "DeadEnd": "Node", "Bend": "Node", "Junction": "Node", "Node": "NetworkElement", "Pipe": "NetworkElement", "MonitoringStation": "Platform",
    **{s[0]: "Sensor" for s in SENSORS.values()}, "QualityCriticalNode": "Node", "CandidateSensorNode": "Node", "InstrumentedNode": "Node",
}
#: Permissible ranges of observed properties.
RANGES = {"pH": (6.5, 8.5), "oxidationReductionPotential": (300.0, 600.0), "dissolvedOxygen": (4.0, None), "totalDissolvedSolids": (None, 500.0), "turbidity": (None, 1.0)}


def name(local: str) -> str:
    return f"<{NS}{local}>"
