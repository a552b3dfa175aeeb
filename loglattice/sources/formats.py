"""Catalogue of log formats, and formats compiled to expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published layouts, masks, similarity thresholds and depths of 16 public log data sets.
FORMATS = {
    "HDFS": ("<Date> <Time> <Pid> <Level> <Component>: <Content>", [r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?"], 0.5, 4),
    "Hadoop": (r"<Year>-<Month>-<Day> <Hour>:<Min>:<Sec>,<mSec> <Level> \[<Process>\] <Component>: <Content>", [r"(\d+\.){3}\d+"], 0.5, 4),
    "Spark": ("<Day>/<Month>/<Year> <Hour>:<min>:<sec> <Level> <Component>: <Content>", [r"(\d+\.){3}\d+", r"\b[KGTM]?B\b", r"([\w-]+\.){2,}[\w-]+"], 0.5, 4),
    "Zookeeper": (r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>", [r"(/|)(\d+\.){3}\d+(:\d+)?"], 0.5, 4),
    "BGL": (r"<Label> <Timestamp> <Year>\.<Mon>\.<D> <Node> <Yearr>-<Month>-<Day>-<Hour>\.<Min>\.<Sec>\.<mSec> <NodeRepeat> <Type> <Component> <Level> <Content>", [r"core\.\d+"], 0.5, 4),
    "HPC": ("<LogId> <Node> <Component> <State> <Time> <Flag> <Content>", [r"=\d+"], 0.5, 4),
    "Thunderbird": (r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>", [r"(\d+\.){3}\d+"], 0.5, 4),
    "Windows": ("<Date> <Time>, <Level>                  <Component>    <Content>", [r"0x.*?\s"], 0.7, 5),
    "Linux": ("<Month> <Date> <Y>:<m>:<s> <Level> <Component>: <Content>", [r"(\d+\.){3}\d+", r"\d{2}:\d{2}:\d{2}"], 0.39, 6),
    "Android": (r"<mon>-<day> <hour>:<min>:<sec>\.<msec>  <Pid>  <Tid> <Level> <Component>: <Content>", [r"(/[\w-]+)+", r"([\w-]+\.){2,}[\w-]+", r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b"], 0.2, 6),
    "HealthApp": (r"<date>-<hour>:<min>:<sec>:<msec>\|<Component>\|<Pid>\|<Content>", [], 0.2, 4),
    "Apache": (r"\[<date> <mon> <day> <hour>:<min>:<sec> <year>\] \[<Level>\] <Content>", [r"(\d+\.){3}\d+"], 0.5, 4),
    "Proxifier": (r"\[<Month>.<Day> <Hour>:<Min>:<Sec>\] <Program> - <Content>", [r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"], 0.6, 3),
    "OpenSSH": (r"<Date> <Day> <Hour>:<Min>:<Sec> <Component> sshd\[<Pid>\]: <Content>", [r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+"], 0.6, 5),
    "OpenStack": (r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>", [r"((\d+\.){3}\d+,?)+", r"/.+?\s", r"\d+"], 0.5, 5),
    "Mac": (r"<Month>  <Date> <H>:<M>:<S> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>", [r"([\w-]+\.){2,}[\w-]+"], 0.7, 6),
}


def compiled(layout: str) -> tuple[str, list[str]]:
    """A layout as an anchored regular expression with one group per field, and the fields' names in order.

    Blanks of the layout match one or more; groups that the layout itself has
    become non-capturing.
    """
    fields, out = [], "^"
    for literal, name in re.findall(r"([^<]*)(?:<(\w+)>)?", layout):
        out += re.sub(r"(?<!\\)\((?!\?)", "(?:", re.sub(r" +", r"\\s+", literal))
        if name:
            fields.append(name)
            out += "(.*)" if name == "Content" else "(.*?)"
    return out + "$", fields


def parse_layout(lines: DataFrame, layout: str, column: str = "line") -> DataFrame:
    """Add a column per field of the layout; all null where the line doesn't fit."""
    pattern, fields = compiled(layout)
    fits = F.col(column).rlike(pattern)
    return lines.withColumns({f: F.when(fits, F.regexp_extract(column, pattern, i + 1)) for i, f in enumerate(fields)})


def masked(text: Column, dataset: str, mark: str = "<*>") -> Column:
    """Text with the data set's masks applied in order."""
    for pattern in FORMATS[dataset][1]:
        text = F.regexp_replace(text, pattern, mark)
    return text


def catalogue(spark) -> DataFrame:
    rows = [(name, layout, masks, st, depth) for name, (layout, masks, st, depth) in FORMATS.items()]
    return spark.createDataFrame(rows, "dataset string, log_format string, regex array<string>, st double, depth int")
