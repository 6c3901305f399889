"""Columns taken from image paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File name endings that count as images.
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "tif", "tiff"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    """Name of the folder that holds the file: the class of an image folder."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(IMAGE_SUFFIXES)


def image_number(name: Column) -> Column:
    """First run of digits, null when there is none."""
    return F.nullif(F.regexp_extract(name, "[0-9]+", 0), F.lit("")).cast("bigint")


def output_name(path: Column, op: str) -> Column:
    return F.concat(stem(path), F.lit(f"_{op}.jpg"))


def decoded_title(url: Column, marker: str = "File:") -> Column:
    """Percent-decoded text after the first marker, null without the marker."""
    position = F.instr(url, marker)
    rest = F.substr(url, position + len(marker))
    # a plus sign is a character in a path, so it is kept from being read as a blank
    return F.when(position > 0, F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))))
