import pytest

from simlattice.schema import CODE, TOKENS
from simlattice.sources.golang import SyntaxProblem, parse_file


def fn(source, name=None):
    rows = parse_file("package p\n" + source, "/x/repo/p/a.go")
    return rows[0] if name is None else next(r for r in rows if r["name"] == name)


def names(f):
    return [TOKENS[t] for t in f["token_seq"]]


def test_signature():
    f = fn("func Multi(a, b int, c string) (n int, err error) { return }")
    assert f["features"]["param_count"] == 3 and f["features"]["return_count"] == 2 and [p["type_name"] for p in f["params"]] == ["int", "int", "string"] and f["is_exported"]
    assert f["features"]["has_error_return"] and [r["is_error"] for r in f["returns"]] == [False, True]
    f = fn("func (s *Store[K]) get(ctx context.Context, f func(int) error, xs ...string) map[string][]*T { return nil }")
    assert f["is_method"] and not f["is_exported"] and f["receiver"] == "" and f["features"]["has_context_param"] and f["features"]["has_func_param"]
    assert [p["type_name"] for p in f["params"]] == ["context.Context", "func", "...string"] and f["returns"][0]["type_name"] == "map[string][]*T"
    assert fn("func (s *Store) x() {}")["receiver"] == "*Store" and fn("func (Store) x(chan<- int, interface{}, []byte, [4]int) {}")["receiver"] == "Store"
    assert [p["type_name"] for p in fn("func x(a chan<- int, b interface{}, c []byte, d [N]int, e List[int]) {}")["params"]] == ["chan int", "interface{}", "[]byte", "[]int", ""]


def test_tokens():
    f = fn("func f() (int, error) { if x := g(); x != nil { return 1, x }; return 0, nil }")
    assert names(f) == ["IF", "ASSIGN", "CALL", "BINARY_OP", "RETURN", "RETURN", "RETURN", "RETURN"]
    assert f["features"]["early_returns"] == 0 and f["features"]["cyclomatic_complexity"] == 2
    f = fn('import ("fmt"; w "x/writer")\nfunc f(b B) { fmt.Println(w.New(), b.Write(), len("x")); a.b.C() }')
    assert names(f) == ["CALL_PKG", "CALL_PKG", "CALL_METHOD", "CALL", "CALL_METHOD"]
    assert f["call_targets"] == ["fmt.Println", "x/writer.New"] and f["direct_imports"] == ["fmt", "x/writer"]
    f = fn('import ("fmt"; "os")\nfunc f() { fmt.Println() }')
    assert f["direct_imports"] == ["fmt"] and f["imports"] == ["fmt", "os"]


def test_statements():
    f = fn("""
func f(ch chan int, m map[string]int) {
	for i := 0; i < 3; i++ { continue }
	for k, v := range m { _ = k; go h(v) }
	for range ch { break }
	for { goto end }
end:
	switch x := y.(type) {
	case int, []string: a()
	default: b()
	}
	select {
	case v := <-ch: _ = v
	case ch <- 1:
	default:
	}
	defer func() { recover() }()
	s := []T{{A: 1}, {B: map[string]int{"k": 2}}}
	p := &T{f: func(a int) bool { return a > 0 && !b || c }}
	_ = s[1:2]; _ = s[0].x.(I); *p = T{}
	var q, r = 1, (2 + 3) * 4
	if t := (T{}); t == (T{}) { } else if v, ok := m["a"]; ok { } else { }
}""")
    assert names(f) == (
        "FOR ASSIGN BINARY_OP CONTINUE RANGE ASSIGN GO CALL RANGE BREAK FOR GOTO SWITCH ASSIGN TYPE_ASSERT CASE CALL CASE CALL SELECT COMM ASSIGN ASSIGN COMM SEND COMM DEFER CALL FUNCLIT CALL "
        "ASSIGN COMPOSITE_LIT COMPOSITE_LIT COMPOSITE_LIT COMPOSITE_LIT ASSIGN COMPOSITE_LIT FUNCLIT RETURN BINARY_OP BINARY_OP BINARY_OP ASSIGN ASSIGN TYPE_ASSERT ASSIGN COMPOSITE_LIT BINARY_OP BINARY_OP "
        "IF ASSIGN COMPOSITE_LIT BINARY_OP COMPOSITE_LIT IF ASSIGN"
    ).split()
    c = f["features"]["control_flow"]
    assert (c["for"], c["range"], c["switch"], c["select"], c["go"], c["send"], c["defer"], c["goto"], c["break"], c["continue"], c["if"]) == (2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 2)
    # 1 + 2 for + 2 range + 1 case + 3 comm + goto + 2 logical + 2 if
    assert f["features"]["cyclomatic_complexity"] == 14 and f["features"]["func_literal_count"] == 2 and f["features"]["goroutine_spawns"] == 1


def test_depths():
    d = lambda body: (lambda x: (x["nesting_depth"], x["branching_depth"], x["cyclomatic_complexity"]))(fn(f"func f() {{ {body} }}")["features"])
    assert d("") == (0, 0, 1) and d("if a { if b { } }") == (2, 2, 3) and d("for { if a { } }") == (2, 1, 3)
    assert d("if a { } else if b { }") == (2, 2, 3) and d("switch a { case 1: if b { } }") == (2, 2, 3) and d("x := func() { if a { } }") == (0, 0, 2)
    assert fn("func f() { return; return; if a { return } }")["features"]["early_returns"] == 2


def test_flags():
    assert fn("func NewT() *T { return &T{a: 1} }")["is_constructor"] and not fn("func NewT() *T { x(); return &T{} }")["is_constructor"] and not fn("func New() *T { return t }")["is_constructor"]
    assert fn("// Code generated by x. DO NOT EDIT.\nfunc f() {}")["generated_code"] and not fn("// about Code generated\nfunc f() {}")["generated_code"]
    assert fn('import "testing"\nfunc f() {}')["test_code"]


def test_lines_and_text():
    f = fn("\n// doc\nfunc a() {\n\tx()\n}\nfunc b() int\nfunc c() { /* } */ s := `\n}`; _ = s }\n", "c")
    assert (f["start_line"], f["end_line"], f["line_count"]) == (8, 9, 2) and f["body"].startswith("func c() {") and f["body"].endswith("_ = s }")
    assert [r["name"] for r in parse_file("package p\nfunc a() {}\nfunc b() int\n")] == ["a"]


def test_wider_go():
    rows = parse_file("""package p

import (
	"fmt"
	_ "embed"
)

type (
	Num interface { ~int | ~float64; String() string }
	Pair[K comparable, V any] struct { Key K; Val V `json:"v"`; *Base; pkg.Other }
	Grid [3][4]int
	Fn func(a, b int) (x, y int)
)

const ( A = iota; B; C )
var m = map[string]func() error{"a": func() error { return nil }}

func Map[T, U any](xs []T, f func(T) U) []U {
	out := make([]U, 0, len(xs))
	for _, x := range xs { out = append(out, f(x)) }
	return out
}

func (p *Pair[K, V]) Set(k K) { p.Key, _ = k, Map[int, string](nil, nil) }

func g(a []int, n int) (r rune) {
	if a[0] < n && n > 0 { r = 'x' } else { r = '\\'' }
	for i := range 10 { _ = i }
	label: for i, j := 0, 1; i < j; i, j = i+1, j-1 { if i == 2 { continue label } }
	switch { case n > 1: fallthrough; case n < 0, n == 1: return }
	switch x := f(); x { case 1: }
	var arr [2]struct{ a int }
	fmt.Printf("%v %v", arr, struct{ b string }{"q"})
	ch := make(chan<- chan int, 1)
	x := <-c
	_ = []interface{}{1, "a", nil}[0].(fmt.Stringer).String()
	_ = *(*int)(ptr) &^ 3 << 2
	func() { defer wg.Done() }()
	return r
}
""")
    assert [r["name"] for r in rows] == ["Map", "Set", "g"] and rows[0]["features"]["param_count"] == 2 and "fmt.Printf" in rows[2]["call_targets"]


@pytest.mark.parametrize("bad", ["func f( {", "func f() { if }", "func f() { x := }", "func f() {", "x", "func f() { a b }", 'func f() { "open }'])
def test_errors_give_no_rows(bad):
    with pytest.raises(SyntaxProblem):
        parse_file("package p\n" + bad)
    assert CODE["IF"] == 0
