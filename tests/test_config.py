import threading

from tickloom.config import Config, column_names

NAMES = ("open", "high", "low", "close", "size", "timestamp", "symbol", "price")


def test_defaults():
    for n in NAMES:
        assert Config.get(f"{n}_column") == n
        assert getattr(column_names, n) == getattr(column_names, f"{n}_column") == n


def test_set_get_reset():
    assert Config.set(price_column="px") is Config
    assert column_names.price == "px" and Config.get("price") == "price"
    Config.set(size_column="qty")
    assert (column_names.price, column_names.size) == ("px", "qty")
    Config.reset()
    assert column_names.price == "price"


def test_fluent_setters():
    for n in NAMES:
        assert getattr(Config, f"set_{n}_column")(f"my_{n}") is Config
        assert getattr(column_names, n) == f"my_{n}"


def test_context_and_decorator_restore():
    with Config(symbol_column="sym"):
        assert column_names.symbol == "sym"
        with Config(symbol_column="inner", price_column="p"):
            assert (column_names.symbol, column_names.price) == ("inner", "p")
        assert (column_names.symbol, column_names.price) == ("sym", "price")
    assert column_names.symbol == "symbol"

    @Config(symbol_column="deco")
    def name():
        return column_names.symbol

    assert name() == "deco" and column_names.symbol == "symbol"


def test_unknown_names():
    Config.set(whatever="x")
    assert Config.get("whatever") == "x"
    assert column_names.nothing == "" and Config.get("nothing_column") == ""


def test_threads_do_not_share():
    Config.set(price_column="px")
    seen = []
    t = threading.Thread(target=lambda: seen.append(column_names.price))
    t.start()
    t.join()
    assert seen == ["price"]
