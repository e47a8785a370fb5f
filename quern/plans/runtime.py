"""Texts that a generated build script is made of, and its assembly.

The helpers run where the generated script is built, never here.
"""

from __future__ import annotations

from quern.operators import codegen

INCLUDES_DEFAULT = "\n".join(f"#include <{h}.h>" for h in ("stdio", "stdlib", "string", "inttypes", "stdint", "strings", "sys/types", "sys/stat", "unistd")) + "\n"

_COMPILE = '''fn compile(code: &str, args: &[&str]) -> bool {
    let dir = std::path::PathBuf::from(std::env::var("OUT_DIR").unwrap());
    let (source, binary) = (dir.join("probe.c"), dir.join("probe.out"));
    if std::fs::write(&source, code).is_err() {
        return false;
    }
    let cc = std::env::var("CC").unwrap_or_else(|_| "cc".to_string());
    std::process::Command::new(cc).arg(&source).arg("-o").arg(&binary).args(args).output().map_or(false, |o| o.status.success())
}
'''

HELPERS = {
    "check_compile": 'fn check_compile(code: &str) -> bool {\n    compile(code, &["-c"])\n}\n',
    "check_link": "fn check_link(code: &str) -> bool {\n    compile(code, &[])\n}\n",
    "check_header": 'fn check_header(name: &str) -> bool {\n    compile(&format!("#include <{}>\\nint probe;\\n", name), &["-c"])\n}\n',
    "check_func": 'fn check_func(name: &str) -> bool {\n    compile(&format!("char {0}(void);\\nint main(void) {{ return {0}() != 0; }}\\n", name), &[])\n}\n',
    "check_decl": 'fn check_decl(name: &str, prelude: &str) -> bool {\n    compile(&format!("{1}\\nint main(void) {{ (void) {0}; return 0; }}\\n", name, prelude), &["-c"])\n}\n',
    "check_type": 'fn check_type(name: &str, prelude: &str) -> bool {\n    compile(&format!("{1}\\nint main(void) {{ return (int) sizeof({0}) == 0; }}\\n", name, prelude), &["-c"])\n}\n',
    "check_sizeof": '''fn check_sizeof(name: &str, prelude: &str) -> Option<usize> {
    // the least size for which the array below has a length of at least one
    (1..=64).find(|n| compile(&format!("{1}\\nchar probe[(sizeof({0}) <= {2}) ? 1 : -1];\\n", name, prelude, n), &["-c"]))
}
''',
    "check_library": '''fn check_library(func: &str, libs: &[&str], others: &[&str], none_first: bool) -> Option<String> {
    let code = format!("char {0}(void);\\nint main(void) {{ return {0}() != 0; }}\\n", func);
    if none_first && compile(&code, &[]) {
        return Some(String::new());
    }
    for lib in libs {
        let flags: Vec<String> = std::iter::once(lib).chain(others).map(|l| format!("-l{}", l.trim_start_matches("-l"))).collect();
        if compile(&code, &flags.iter().map(String::as_str).collect::<Vec<_>>()) {
            return Some(lib.to_string());
        }
    }
    None
}
''',
    "execute_cmd": '''fn execute_cmd(program: &str, args: &[&str]) -> Option<String> {
    let out = std::process::Command::new(program).args(args).output().ok()?;
    out.status.success().then(|| String::from_utf8_lossy(&out.stdout).trim().to_string())
}
''',
    "run_pkg_config": '''struct Package { cflags: Vec<String>, libs: Vec<String> }
fn run_pkg_config(name: &str) -> Option<Package> {
    let ask = |what: &str| execute_cmd("pkg-config", &[what, name]).map(|s| s.split_whitespace().map(str::to_string).collect());
    Some(Package { cflags: ask("--cflags")?, libs: ask("--libs")? })
}
''',
    "run_bindgen": '''fn run_bindgen(flags: impl Iterator<Item = String>) {
    let out = std::path::PathBuf::from(std::env::var("OUT_DIR").unwrap()).join("bindings.rs");
    bindgen::Builder::default().header("wrapper.h").clang_args(flags).generate().expect("bindings").write_to_file(out).expect("written");
}
''',
}
#: What a helper calls itself.
NEEDS = {"run_pkg_config": ["execute_cmd"]}


def record(path: str) -> str:
    """A helper that appends ``category,key,"value"`` to a file."""
    return f'''fn record(category: &str, key: &str, value: &str) {{
    use std::io::Write;
    if let Ok(mut f) = std::fs::OpenOptions::new().create(true).append(true).open("{path}") {{
        let _ = writeln!(f, "{{}},{{}},\\"{{}}\\"", category, key, value.replace('"', "\\"\\""));
    }}
}}
'''


def predefinitions(code: str) -> str:
    """The helpers that a text calls, and what these call."""
    names = codegen.required_functions(code)
    names += [x for n in names for x in NEEDS.get(n, ()) if x not in names]
    probes = any(n.startswith("check_") for n in names)
    return "use std::path::PathBuf;\n" + (_COMPILE if probes else "") + "".join(HELPERS[n] for n in HELPERS if n in names)


def build_rs(functions: list[str], body: list[str], init: list[str] = (), exports: list[str] = (), record_path: str | None = None) -> str:
    """A whole build script: helpers, main with its parts in order, then the functions of the chunks."""
    inner = [*init, *body, *exports]
    main = "fn main() {\n" + "".join("    " + line + "\n" for part in inner for line in part.split("\n")) + "}\n"
    code = main + "\n".join(functions)
    return predefinitions(code) + (record(record_path) if record_path else "") + code


def bindgen_call(flag_variables: list[str]) -> str:
    parts = [f"{v}.iter().flat_map(|x| x.split_whitespace()).map(str::to_string)" for v in flag_variables]
    chain = "std::iter::empty::<String>()" + "".join(f".chain({p})" for p in parts)
    return f"run_bindgen({chain});"


def environment(name: str, kind: str) -> str:
    """A variable's start value from the build environment, by type."""
    text = f'option_env!("{name}").unwrap_or_default()'
    if kind == "Boolean":
        return f'let mut {name}: bool = matches!({text}, "yes" | "1" | "true" | "on");'
    if kind == "Integer":
        return f"let mut {name}: usize = {text}.parse().unwrap_or_default();"
    if kind == "Path":
        return f"let mut {name}: PathBuf = PathBuf::from({text});"
    if kind.startswith("List"):
        return f"let mut {name}: Vec<String> = {text}.split_whitespace().map(str::to_string).collect();"
    return f"let mut {name}: String = {text}.to_string();"
