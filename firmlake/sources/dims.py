"""Fixed values of the formats: chips, their address maps, and names of codes."""

from __future__ import annotations

# Address maps as (name, low, high), in the order that breaks ties; executable regions apart.
REGIONS = {
    "esp32": [
        ("drom", 0x3F400000, 0x3F800000),
        ("extram_data", 0x3F800000, 0x3FC00000),
        ("rtc_dram", 0x3FF80000, 0x3FF82000),
        ("dram", 0x3FFAE000, 0x40000000),
        ("diram_dram", 0x3FFE0000, 0x40000000),
        ("irom_mask", 0x40000000, 0x40070000),
        ("cache_pro", 0x40070000, 0x40078000),
        ("cache_app", 0x40078000, 0x40080000),
        ("iram", 0x40080000, 0x400AA000),
        ("diram_iram", 0x400A0000, 0x400C0000),
        ("rtc_iram", 0x400C0000, 0x400C2000),
        ("irom", 0x400D0000, 0x40400000),
        ("rtc_data", 0x50000000, 0x50002000),
    ],
    "esp32s2": [
        ("drom", 0x3F000000, 0x3FF80000),
        ("extram_data", 0x3F500000, 0x3FF80000),
        ("rtc_dram", 0x3FF9E000, 0x3FFA0000),
        ("dram", 0x3FFB0000, 0x40000000),
        ("diram_dram", 0x3FFB0000, 0x40000000),
        ("irom_mask", 0x40000000, 0x40020000),
        ("iram", 0x40020000, 0x40070000),
        ("diram_iram", 0x40020000, 0x40070000),
        ("rtc_iram", 0x40070000, 0x40072000),
        ("irom", 0x40080000, 0x40800000),
        ("rtc_data", 0x50000000, 0x50002000),
    ],
    "esp32s3": [
        ("drom", 0x3C000000, 0x3E000000),
        ("extram_data", 0x3C000000, 0x3E000000),
        ("dram", 0x3FC88000, 0x3FD00000),
        ("diram_dram", 0x3FC88000, 0x3FCF0000),
        ("irom_mask", 0x40000000, 0x40060000),
        ("iram", 0x40370000, 0x403E0000),
        ("diram_iram", 0x40378000, 0x403E0000),
        ("irom", 0x42000000, 0x44000000),
        ("rtc_data", 0x50000000, 0x50002000),
        ("rtc_iram", 0x600FE000, 0x60100000),
    ],
}
EXECUTABLE = {"irom_mask", "iram", "diram_iram", "rtc_iram", "irom"}
CHIP_IDS = {0x0000: "esp32", 0x0002: "esp32s2", 0x0009: "esp32s3", 0x0005: "esp32c3", 0x000C: "esp32c2", 0x000D: "esp32c6", 0x0010: "esp32h2", 0x0012: "esp32p4", 0x0017: "esp32c5"}
MODES = {0: "qio", 1: "qout", 2: "dio", 3: "dout", 4: "fast_read", 5: "slow_read"}
SPEEDS = {0: "div_2", 1: "div_3", 2: "div_4", 15: "div_1"}
SIZES = {0: "1MB", 1: "2MB", 2: "4MB", 3: "8MB", 4: "16MB", 5: "32MB", 6: "64MB", 7: "128MB"}
TYPES = {0: "app", 1: "data"}
APP_SUBTYPES = {0x00: "factory", **{0x10 + i: f"ota_{i}" for i in range(16)}, 0x20: "test"}
DATA_SUBTYPES = {0: "ota", 1: "phy", 2: "nvs", 3: "coredump", 4: "nvs_keys", 5: "efuse", 6: "undefined", 0x80: "esphttpd", 0x81: "fat", 0x82: "spiffs", 0x83: "littlefs"}


def supported(chip: str) -> bool:
    return chip in REGIONS


def region_of(chip: str | None, addr: int) -> str | None:
    """Name of the smallest region holding the address; of equals, the first."""
    holding = [(high - low, k, name) for k, (name, low, high) in enumerate(REGIONS.get(chip or "", ())) if low <= addr < high]
    return min(holding)[2] if holding else None
