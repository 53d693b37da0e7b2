"""Fields of radar instrument packets as column expressions over binary headers.

``field(b, at, size)`` reads ``size`` bytes from byte ``at`` as an unsigned
big-endian number; the named fields follow the packet layout (a 6-byte primary
and a 62-byte secondary header).  A header that is too short gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reference frequency in Hz, the sync word, the valid compression modes, and sample rates by decimation code.
F_REF = 37.53472224e6
SYNC_MARKER = 0x352EF853
BAQ_MODES = (0, 3, 4, 5, 12, 13, 14)
RATE_BY_DECIMATION = {0: 3, 1: 8 / 3, 3: 20 / 9, 4: 16 / 9, 5: 3 / 2, 6: 4 / 3, 7: 2 / 3, 8: 12 / 7, 9: 5 / 4, 10: 6 / 13, 11: 16 / 11}


def field(b: Column, at: int, size: int) -> Column:
    """Unsigned big-endian number of ``size`` bytes at ``at``."""
    raw = F.substring(b, at + 1, size)
    return F.when(F.octet_length(b) >= at + size, F.conv(F.hex(raw), 16, 10).cast("long"))


def bits(value: Column, shift: int, width: int) -> Column:
    """``width`` bits above the lowest ``shift``."""
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1)) if shift else value.bitwiseAND(F.lit((1 << width) - 1))


def _signed(value: Column, width: int) -> tuple[Column, Column]:
    """(top bit, magnitude below it)."""
    return bits(value, width - 1, 1), bits(value, 0, width - 1)


#: name -> (byte, bytes, shift, width or None for all)
PRIMARY_FIELDS = {
    "packet_version_number": (0, 2, 13, 3),
    "packet_type": (0, 2, 12, 1),
    "secondary_header_flag": (0, 2, 11, 1),
    "process_id": (0, 2, 4, 7),
    "packet_category": (0, 2, 0, 4),
    "sequence_flags": (2, 2, 14, 2),
    "packet_sequence_count": (2, 2, 0, 14),
}
SECONDARY_FIELDS = {
    "coarse_time": (0, 4, 0, None),
    "sync_marker": (6, 4, 0, None),
    "data_take_id": (10, 4, 0, None),
    "ecc_number": (14, 1, 0, None),
    "test_mode": (15, 1, 4, 3),
    "rx_channel_id": (15, 1, 0, 4),
    "instrument_config_id": (16, 4, 0, None),
    "subcom_data_word_index": (20, 1, 0, None),
    "subcom_data_word": (21, 2, 0, None),
    "space_packet_count": (23, 4, 0, None),
    "pri_count": (27, 4, 0, None),
    "error_flag": (31, 1, 7, 1),
    "baq_mode": (31, 1, 0, 5),
    "baq_block_length": (32, 1, 0, None),
    "range_decimation": (34, 1, 0, None),
    "rank": (43, 1, 0, 5),
    "sas_ssb_flag": (53, 1, 7, 1),
    "polarisation": (53, 1, 4, 3),
    "temperature_compensation": (53, 1, 2, 2),
    "calibration_mode": (56, 1, 6, 2),
    "tx_pulse_number": (56, 1, 0, 5),
    "signal_type": (57, 1, 4, 4),
    "swap_flag": (57, 1, 0, 1),
    "swath_number": (58, 1, 0, None),
    "number_of_quads": (59, 2, 0, None),
}


def _plain(b: Column, spec: tuple) -> Column:
    at, size, shift, width = spec
    value = field(b, at, size)
    return value if width is None else bits(value, shift, width)


def packet_data_length(b: Column) -> Column:
    return field(b, 4, 2) + 1


def fine_time(b: Column) -> Column:
    """Seconds within the coarse second."""
    return (field(b, 4, 2) + 0.5) / 65536


def rx_gain(b: Column) -> Column:
    """dB."""
    return field(b, 35, 1) * -0.5


def tx_pulse_ramp_rate(b: Column) -> Column:
    """Hz/s; a set top bit means rising."""
    up, size = _signed(field(b, 36, 2), 16)
    return F.when(up == 1, 1.0).when(up == 0, -1.0) * size * (F_REF * F_REF / 2**21)


def tx_pulse_start_frequency(b: Column) -> Column:
    """Hz."""
    up, size = _signed(field(b, 38, 2), 16)
    return tx_pulse_ramp_rate(b) / (4 * F_REF) + F.when(up == 1, 1.0).when(up == 0, -1.0) * size * (F_REF / 2**14)


def _clock(b: Column, at: int) -> Column:
    return field(b, at, 3) / F_REF


def tx_pulse_length(b: Column) -> Column:
    return _clock(b, 40)


def pri(b: Column) -> Column:
    return _clock(b, 44)


def sampling_window_start_time(b: Column) -> Column:
    return _clock(b, 47)


def sampling_window_length(b: Column) -> Column:
    return _clock(b, 50)


def sample_rate(code: Column) -> Column:
    """Hz by decimation code; an unknown code is an error."""
    out = F.when(code.isNull(), None)
    for k, ratio in RATE_BY_DECIMATION.items():
        out = out.when(code == k, ratio * F_REF)
    return out.otherwise(F.raise_error(F.concat(F.lit("no such range decimation code: "), code.cast("string"))).cast("double"))


def ten_bit_signed(x: Column) -> Column:
    """Sign and magnitude: bit 9 is the sign."""
    return F.when(bits(x, 9, 1) == 1, -1).otherwise(1) * bits(x, 0, 9)


def bypass_samples(data: Column, n: int) -> Column:
    """n signed 10-bit samples from packed bytes."""

    def sample(i: Column) -> Column:
        first = F.floor(i * 10 / 8).cast("int")
        word = F.conv(F.hex(F.substring(data, first + 1, F.lit(2))), 16, 10).cast("long")
        shift = (6 - (i * 10) % 8).cast("int")
        return ten_bit_signed(F.call_function("shiftright", word, shift).bitwiseAND(F.lit(1023)))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), sample)


def primary_header(b: Column) -> Column:
    """All fields of the primary header as a struct."""
    return F.struct(*[_plain(b, s).alias(k) for k, s in PRIMARY_FIELDS.items()], packet_data_length(b).alias("packet_data_length"))


def secondary_header(b: Column) -> Column:
    """All fields of the secondary header as a struct."""
    derived = {"fine_time": fine_time, "rx_gain": rx_gain, "tx_pulse_ramp_rate": tx_pulse_ramp_rate, "tx_pulse_start_frequency": tx_pulse_start_frequency, "tx_pulse_length": tx_pulse_length, "pri": pri, "sampling_window_start_time": sampling_window_start_time, "sampling_window_length": sampling_window_length}
    return F.struct(*[_plain(b, s).alias(k) for k, s in SECONDARY_FIELDS.items()], *[f(b).alias(k) for k, f in derived.items()])


def packet_header(primary: Column, secondary: Column) -> Column:
    return F.struct(primary_header(primary).alias("primary"), secondary_header(secondary).alias("secondary"))


def valid_sync_marker(marker: Column) -> Column:
    return marker == SYNC_MARKER


def valid_packet_version(version: Column) -> Column:
    return version == 0


def valid_baq_mode(mode: Column) -> Column:
    return mode.isin(*BAQ_MODES)
