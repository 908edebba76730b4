"""GPX: tracks, segments and points, by an event parser; names count without their prefix."""

from __future__ import annotations

from xml.parsers import expat

from ..config import MAX_RECORDING_POINTS
from .errors import Unreadable

# Element names and the columns that they fill.
_PLAIN = {"ele": "elevation_m", "time": "recorded_at", "hdop": "hdop", "speed": "recorded_speed_mps"}
_EXTENSION = {"hr": "heart_rate_bpm", "cad": "cadence_rpm", "cadence": "cadence_rpm", "bike_cadence": "cadence_rpm", "speed_sensor": "sensor_speed_mps", "bike_speed": "sensor_speed_mps", "sensor_speed": "sensor_speed_mps"}
_COLUMNS = [*_PLAIN.values(), "heart_rate_bpm", "cadence_rpm", "sensor_speed_mps", "sensor_distance_m"]


def _coordinate(text: str | None, most: float) -> float | None:
    try:
        value = float(text or "")
    except ValueError:
        return None
    return value if -most <= value <= most else None


class _Reader:
    def __init__(self):
        self.path: list[str] = []
        self.text: list[str] = []
        self.points: list[dict] = []
        self.point: dict | None = None
        self.track = self.segment = -1
        self.invalid = 0
        self.creator = self.title = self.first_name = self.activity = self.route = None

    def start(self, name: str, attributes: dict) -> None:
        own = name.rpartition(":")[2]
        self.path.append(own)
        self.text = []
        if own == "gpx":
            self.creator = attributes.get("creator")
        elif own == "trk":
            self.track, self.segment = self.track + 1, -1
        elif own == "trkseg":
            self.segment += 1
        elif own == "trkpt":
            lat, lon = _coordinate(attributes.get("lat"), 90), _coordinate(attributes.get("lon"), 180)
            self.point = None if lat is None or lon is None else {"track_position": self.track, "segment_position": self.segment, "latitude": lat, "longitude": lon, "extras": {}, **dict.fromkeys(_COLUMNS)}
            self.invalid += self.point is None

    def data(self, text: str) -> None:
        self.text.append(text)

    def end(self, name: str) -> None:
        own, text = self.path.pop(), "".join(self.text).strip()
        self.text = []
        inside = self.path
        if own == "trkpt":
            if self.point is not None:
                if len(self.points) >= MAX_RECORDING_POINTS:
                    raise Unreadable("too many points")
                self.points.append({**self.point, "position": len(self.points)})
            self.point = None
        elif self.point is not None and text:
            if "extensions" in inside:
                self.point["extras"][own] = text
                if own in _EXTENSION:
                    self.point[_EXTENSION[own]] = text
            elif own in _PLAIN and inside[-1] == "trkpt":
                self.point[_PLAIN[own]] = text
        elif own == "name" and text:
            if inside[-1] == "metadata":
                self.title = text
            elif inside[-1] == "trk":
                self.first_name = self.first_name or text
        elif "metadata" in inside and "extensions" in inside and text:
            if own == "activity":
                self.activity = text
            elif own == "route":
                self.route = text


def parse(content: bytes) -> dict:
    """Points and what the file says of itself; points whose position isn't one are counted and left out.  A DOCTYPE is refused."""
    if b"<!DOCTYPE" in content:
        raise Unreadable("a document type is not allowed")
    reader = _Reader()
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.data
    try:
        parser.Parse(content, True)
    except expat.ExpatError as problem:
        raise Unreadable(f"not well-formed: {problem}") from None
    return {"name": reader.title or reader.first_name, "creator": reader.creator, "activity_type": reader.activity or reader.route, "invalid_point_count": reader.invalid, "records_without_position": 0, "warnings": [], "points": reader.points}
