"""The known sources and how each is read: entity kind, format, whether it reports a rolling window or one own venue."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Source:
    id: str
    entity: str
    format: str
    own_venue: bool = False
    rolling: bool = False


# The sources.
SOURCES = [
    Source("arte-events", "event", "xml", own_venue=True, rolling=True),
    Source("boch-heritage-arts-crafts", "heritage", "json"),
    Source("boch-heritage-folklore", "heritage", "json"),
    Source("boch-heritage-preservers", "person", "json"),
    Source("boch-heritage", "heritage", "json"),
    Source("changhua-performing-groups", "organization", "csv"),
    Source("chiayi-city-buskers", "person", "csv"),
    Source("chiayi-county-event-board", "event", "json", own_venue=True),
    Source("cip-culture-halls", "venue", "json"),
    Source("cip-indigenous-festivals", "event", "json"),
    Source("cip-museums", "venue", "json"),
    Source("hakka-liudui-events", "event", "json"),
    Source("hsinchu-city-buskers", "person", "csv"),
    Source("hsinchu-city-culture-events", "event", "json"),
    Source("hsinchu-city-culture-venues", "venue", "json"),
    Source("hsinchu-county-culture-events", "event", "json"),
    Source("hsinchu-county-culture-venues", "venue", "json"),
    Source("hsinchu-county-performing-groups", "organization", "csv"),
    Source("kaohsiung-busker-venues", "venue", "csv"),
    Source("kaohsiung-buskers", "person", "json"),
    Source("kaohsiung-neighborhood-centers", "venue", "json"),
    Source("kaohsiung-public-libraries", "venue", "csv"),
    Source("kmfa-events", "event", "html", own_venue=True),
    Source("moc-buskers", "person", "json"),
    Source("moc-community", "organization", "json"),
    Source("moc-emap-poi", "venue", "json"),
    Source("moc-events", "event", "json"),
    Source("moc-perform-place", "venue", "json"),
    Source("moca-taipei-events", "event", "html", own_venue=True),
    Source("nantou-arts-events", "event", "csv"),
    Source("nantou-culture-venues", "venue", "csv"),
    Source("national-public-libraries", "venue", "json"),
    Source("ncfta-activities", "event", "html", own_venue=True),
    Source("ncl-events", "event", "xml", own_venue=True, rolling=True),
    Source("nmmba-exhibitions", "event", "json", own_venue=True),
    Source("nmns-exhibitions", "event", "html", own_venue=True),
    Source("npm-events", "event", "html", own_venue=True),
    Source("nstm-activities", "event", "json", own_venue=True, rolling=True),
    Source("nstm-exhibitions", "event", "json", own_venue=True),
    Source("ntch-programs", "event", "json", own_venue=True),
    Source("ntm-activities", "event", "html", own_venue=True),
    Source("ntmofa-events", "event", "html", own_venue=True),
    Source("ntpc-buskers", "person", "csv"),
    Source("ntpc-city-museums", "venue", "csv"),
    Source("ntpc-culture-events", "event", "json"),
    Source("ntpc-museum-venues", "venue", "json"),
    Source("ntpc-performing-groups", "organization", "csv"),
    Source("ntt-programs", "event", "html", own_venue=True),
    Source("penghu-cultural-organizations", "organization", "xml"),
    Source("pingtung-public-libraries", "venue", "csv"),
    Source("taichung-artists", "person", "xml"),
    Source("taichung-arts-groups", "organization", "csv"),
    Source("taichung-culture-events", "event", "csv"),
    Source("taichung-culture-venues", "venue", "json"),
    Source("taichung-museums", "venue", "json"),
    Source("taichung-performing-groups", "organization", "csv"),
    Source("tainan-culture-events", "event", "json"),
    Source("tainan-culture-halls", "venue", "json"),
    Source("tainan-culture-venues", "venue", "csv"),
    Source("tainan-indigenous-performing-groups", "organization", "json"),
    Source("tainan-public-libraries", "venue", "json"),
    Source("taipei-artist-village-residents", "person", "csv"),
    Source("taipei-buskers", "person", "csv"),
    Source("taipei-culture-events", "event", "json"),
    Source("taipei-culture-promotion-halls", "venue", "csv"),
    Source("taipei-culture-venues", "venue", "csv"),
    Source("taipei-disabled-buskers", "person", "csv"),
    Source("taipei-gov-hot-events", "event", "json", own_venue=True, rolling=True),
    Source("taipei-performing-groups", "organization", "csv"),
    Source("taipei-private-museums", "venue", "csv"),
    Source("taipei-public-libraries", "venue", "csv"),
    Source("taoyuan-tourism-events", "event", "json"),
    Source("tcmb-culture", "heritage", "json"),
    Source("tfam-exhibitions", "event", "json", own_venue=True),
    Source("tnam-events", "event", "html", own_venue=True),
    Source("tpac-programs", "event", "html", own_venue=True),
    Source("twtourism-events", "event", "json"),
    Source("weiwuying-programs", "event", "json", own_venue=True),
    Source("ysnp-activities", "event", "html", own_venue=True),
]
BY_ID = {s.id: s for s in SOURCES}


def matching(text: str) -> list[Source]:
    """Sources whose id contains a text."""
    return [s for s in SOURCES if text in s.id]
