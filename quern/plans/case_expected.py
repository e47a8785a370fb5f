"""What the case queries return, as the operators gave it and read through against the scripts: for each query its columns after script_id, and rows of (case, values)."""

EXPECTED = {
    "case_nodes": (
        ('node_id', 'parent_id', 'branch', 'kind', 'line', 'exit_id'),
        [
            ('loops', 1, None, None, 'Case', 1, 4),
            ('loops', 2, 1, 0, 'Assignment', 2, 3),
            ('loops', 3, 1, 1, 'Assignment', 3, 4),
            ('loops', 4, None, None, 'For', 5, 7),
            ('loops', 5, 4, 0, 'Command', 6, 6),
            ('loops', 6, 4, 0, 'Command', 7, 7),
            ('loops', 7, None, None, 'Case', 9, 11),
            ('loops', 8, 7, 0, 'Assignment', 10, 9),
            ('loops', 9, 7, 1, 'Assignment', 11, 10),
            ('loops', 10, 7, 2, 'Assignment', 12, 11),
            ('commands', 1, None, None, 'Assignment', 1, 2),
            ('commands', 2, None, None, 'Command', 2, 3),
            ('commands', 3, None, None, 'Redirect', 3, 5),
            ('commands', 4, 3, 0, 'Command', 3, 5),
            ('commands', 5, None, None, 'Pipe', 4, 9),
            ('commands', 6, 5, 0, 'Command', 4, 7),
            ('commands', 7, 5, 0, 'Redirect', 4, 9),
            ('commands', 8, 7, 0, 'Command', 4, 9),
            ('commands', 9, None, None, 'Command', 5, 10),
            ('commands', 10, None, None, 'Or', 6, 12),
            ('commands', 11, 10, 0, 'Command', 6, 12),
            ('commands', 12, None, None, 'While', 7, 15),
            ('commands', 13, 12, 0, 'Assignment', 8, 14),
            ('commands', 14, 12, 0, 'Command', 9, 15),
        ],
    ),
    "case_rendered": (
        ('node_id', 'source'),
        [
            ('branches', 1, "p_{name}='{num}'"),
            ('branches', 2, 'if test "x${with_{name}}" = xyes && test -n "${CC}"; then\n  LIBS="${LIBS} -l{name}"\nelif test ${level} -ge 3; then\n  LIBS=\'none\'\nelse\n  AC_MSG_ERROR([no {name}])\nfi'),
            ('branches', 6, 'if test -n "${EXTRA+set}"; then\n  EXTRA=\'no\'\nfi'),
            ('loops', 1, "case ${host} in\n  i?86-*-linux*)\n    os='linux'\n    ;;\n  *)\n    os='other'\n    ;;\nesac"),
            ('loops', 4, 'for f in a {name}; do\n  eval "have_${f}=${os}"\n  eval "v=\\$have_${f}"\ndone'),
            ('loops', 7, "case ${v} in\n  yes)\n    w='1'\n    ;;\n  no|off)\n    w='0'\n    ;;\n  *)\n    w=${v}\n    ;;\nesac"),
            ('commands', 1, 'n=$(( {num} * 2 + count ))'),
            ('commands', 2, 'echo start'),
            ('commands', 3, 'echo ${n} > out_{name}.txt'),
            ('commands', 5, 'cat in.txt | grep ${n} > log.txt'),
            ('commands', 9, 'rm -f log.txt tmp'),
            ('commands', 10, 'test -f ${n} || exit 1'),
            ('commands', 12, 'while test ${n} -lt 9; do\n  n=$((n > 3 ? n : count))\n  break\ndone'),
        ],
    ),
    "case_guards": (
        ('node_id', 'guards', 'error_out'),
        [
            ('branches', 3, '(!Var CC Empty & Var with_{name} True)', False),
            ('branches', 4, '((!Var with_{name} True | Var CC Empty) & Var level Ge 3)', False),
            ('branches', 5, '(!Var level Ge 3 & (!Var with_{name} True | Var CC Empty))', True),
            ('branches', 7, 'Var EXTRA Set', False),
            ('loops', 2, '(ArchGlob Match i?86 & OsAbiGlob Match linux*)', False),
            ('loops', 3, '(!ArchGlob Match i?86 | !OsAbiGlob Match linux*)', False),
            ('loops', 8, 'Var v True', False),
            ('loops', 9, '(!Var v True & (Var v Eq off | Var v False))', False),
            ('loops', 10, '(!Var v Eq off & !Var v False & !Var v True)', False),
        ],
    ),
    "case_guard_terms": (
        ('node_id', 'guard', 'negated', 'atom_kind', 'name', 'cond_kind', 'operand'),
        [
            ('branches', 2, 0, False, 'Var', 'with_{name}', 'True', ''),
            ('branches', 2, 0, True, 'Var', 'CC', 'Empty', ''),
            ('branches', 2, 1, False, 'Var', 'level', 'Ge', '3'),
            ('branches', 6, 0, False, 'Var', 'EXTRA', 'Set', ''),
            ('loops', 1, 0, False, 'ArchGlob', '', 'Match', 'i?86'),
            ('loops', 1, 0, False, 'OsAbiGlob', '', 'Match', 'linux*'),
            ('loops', 7, 0, False, 'Var', 'v', 'True', ''),
            ('loops', 7, 1, False, 'Var', 'v', 'Eq', 'off'),
            ('loops', 7, 1, False, 'Var', 'v', 'False', ''),
            ('options', 7, 0, False, 'Var', 'use', 'True', ''),
            ('options', 10, 0, False, 'Var', 'use', 'True', ''),
            ('options', 10, 1, False, 'Var', 'use', 'Eq', 'fast'),
        ],
    ),
    "case_events": (
        ('node_id', 'ord', 'event', 'var'),
        [
            ('branches', 1, 0, 'def', 'p_{name}'),
            ('branches', 2, 0, 'use', 'with_{name}'),
            ('branches', 2, 1, 'use', 'CC'),
            ('branches', 2, 2, 'use', 'level'),
            ('branches', 3, 0, 'use', 'LIBS'),
            ('branches', 3, 1, 'def', 'LIBS'),
            ('branches', 4, 0, 'def', 'LIBS'),
            ('branches', 6, 0, 'use', 'EXTRA'),
            ('branches', 7, 0, 'def', 'EXTRA'),
            ('loops', 1, 0, 'use', 'host'),
            ('loops', 2, 0, 'def', 'os'),
            ('loops', 3, 0, 'def', 'os'),
            ('loops', 4, 0, 'bound', 'f'),
            ('loops', 5, 0, 'use', 'f'),
            ('loops', 5, 1, 'use', 'os'),
            ('loops', 6, 0, 'use', 'f'),
            ('loops', 6, 1, 'def', 'v'),
            ('loops', 7, 0, 'use', 'v'),
            ('loops', 8, 0, 'def', 'w'),
            ('loops', 9, 0, 'def', 'w'),
            ('loops', 10, 0, 'use', 'v'),
            ('loops', 10, 1, 'def', 'w'),
            ('order', 1, 0, 'use', 'CC'),
            ('order', 2, 0, 'def', 'x'),
            ('order', 4, 0, 'use', 'x'),
            ('order', 4, 1, 'def', 'y'),
            ('order', 5, 0, 'def', 'z'),
            ('order', 6, 0, 'def', 'x'),
            ('order', 7, 0, 'use', 'y'),
            ('order', 8, 0, 'bound', 'i'),
            ('order', 9, 0, 'use', 'i'),
            ('order', 9, 1, 'def', 'p'),
            ('order', 10, 0, 'use', 'x'),
            ('order', 10, 1, 'use', 'p'),
        ],
    ),
    "case_fragments": (
        ('node_id', 'word', 'pos', 'kind', 'text'),
        [
            ('commands', 1, 0, 0, 'arith', ' {num} * 2 + count '),
            ('commands', 2, 0, 0, 'lit', 'echo'),
            ('commands', 2, 1, 0, 'lit', 'start'),
            ('commands', 4, 0, 0, 'lit', 'echo'),
            ('commands', 4, 1, 0, 'var', 'n'),
            ('commands', 6, 0, 0, 'lit', 'cat'),
            ('commands', 6, 1, 0, 'lit', 'in.txt'),
        ],
    ),
    "case_arithmetic": (
        ('node_id', 'pos', 'kind', 'text'),
        [
            ('commands', 1, 0, 'bin', '+'),
            ('commands', 1, 1, 'bin', '*'),
            ('commands', 1, 2, 'num', '{num}'),
            ('commands', 1, 3, 'num', '2'),
            ('commands', 1, 4, 'var', 'count'),
            ('commands', 13, 0, 'cond', ''),
            ('commands', 13, 1, 'bin', '>'),
            ('commands', 13, 2, 'var', 'n'),
            ('commands', 13, 3, 'num', '3'),
            ('commands', 13, 4, 'var', 'n'),
            ('commands', 13, 5, 'var', 'count'),
        ],
    ),
    "case_type_hints": (
        ('var', 'hint', 'arg'),
        [
            ('branches', 'EXTRA', 'Boolean', 'no'),
            ('branches', 'EXTRA', 'ReadBeforeWrite', ''),
            ('branches', 'LIBS', 'AppendSelf', ''),
            ('branches', 'LIBS', 'Literal', 'none'),
            ('branches', 'LIBS', 'ReadBeforeWrite', ''),
            ('branches', 'level', 'Integer', ''),
            ('branches', 'p_{name}', 'Integer', '{num}'),
            ('branches', 'with_{name}', 'Boolean', 'xyes'),
            ('loops', 'f', 'Iterated', ''),
            ('loops', 'os', 'Literal', 'linux'),
            ('loops', 'os', 'Literal', 'other'),
            ('loops', 'v', 'Boolean', 'no'),
            ('loops', 'v', 'Boolean', 'off'),
            ('loops', 'v', 'Boolean', 'yes'),
            ('loops', 'w', 'Boolean', '0'),
            ('loops', 'w', 'Boolean', '1'),
            ('loops', 'w', 'Copies', 'v'),
            ('commands', 'count', 'Calculated', ''),
            ('commands', 'n', 'Calculated', ''),
            ('commands', 'n', 'Integer', ''),
            ('commands', 'n', 'Path', ''),
        ],
    ),
    "case_types": (
        ('var', 'type'),
        [
            ('branches', 'EXTRA', 'Boolean'),
            ('branches', 'LIBS', 'List<Literal>'),
            ('branches', 'level', 'Integer'),
            ('branches', 'p_{name}', 'Integer'),
            ('branches', 'with_{name}', 'Boolean'),
            ('loops', 'f', 'Literal'),
            ('loops', 'os', 'Literal'),
            ('loops', 'v', 'Boolean'),
            ('loops', 'w', 'Boolean'),
            ('commands', 'count', 'Integer'),
            ('commands', 'n', 'Path'),
            ('order', 'i', 'Literal'),
            ('order', 'p', 'Literal'),
            ('order', 'x', 'Integer'),
            ('order', 'y', 'Integer'),
            ('order', 'z', 'Literal'),
        ],
    ),
    "case_def_use": (
        ('var', 'def_node', 'use_node'),
        [
            ('loops', 'f', 4, 5),
            ('loops', 'f', 4, 6),
            ('loops', 'os', 1, 5),
            ('loops', 'v', 6, 7),
            ('loops', 'v', 6, 10),
            ('order', 'i', 8, 9),
            ('order', 'p', 9, 10),
            ('order', 'x', 2, 4),
            ('order', 'x', 6, 10),
            ('order', 'y', 4, 7),
        ],
    ),
    "case_dependencies": (
        ('def_node', 'use_node', 'vars'),
        [
            ('order', 2, 4, 'x'),
            ('order', 4, 7, 'y'),
            ('order', 6, 10, 'x'),
            ('order', 8, 9, 'i'),
            ('order', 9, 10, 'p'),
        ],
    ),
    "case_chunks": (
        ('chunk', 'node_id', 'first_line', 'last_line'),
        [
            ('order', 0, 1, 1, 1),
            ('order', 1, 2, 2, 2),
            ('order', 2, 3, 3, 3),
            ('order', 3, 4, 4, 4),
            ('order', 4, 5, 5, 5),
            ('order', 5, 6, 6, 6),
            ('order', 6, 7, 7, 7),
            ('order', 7, 8, 8, 11),
            ('order', 7, 10, 8, 11),
            ('order', 8, 11, 12, 12),
            ('branches', 0, 1, 1, 1),
            ('branches', 1, 2, 2, 8),
            ('branches', 2, 6, 9, 11),
        ],
    ),
    "case_chunk_io": (
        ('chunk', 'var', 'role'),
        [
            ('order', 1, 'x', 'return'),
            ('order', 3, 'x', 'arg'),
            ('order', 3, 'y', 'return'),
            ('order', 4, 'z', 'internal'),
            ('order', 5, 'x', 'return'),
            ('order', 6, 'y', 'arg'),
            ('order', 7, 'i', 'internal'),
            ('order', 7, 'p', 'internal'),
            ('order', 7, 'x', 'arg'),
        ],
    ),
    "case_scopes": (
        ('var', 'idx', 'owner', 'bound_by', 'readers', 'writers', 'overwriters'),
        [
            ('order', 'CC', 0, None, None, '0', '', ''),
            ('order', 'i', 0, 7, 7, '', '', '7'),
            ('order', 'p', 0, 7, None, '', '', '7'),
            ('order', 'x', 0, 1, None, '3', '', '1'),
            ('order', 'x', 1, 5, None, '7', '', '5'),
            ('order', 'y', 0, 3, None, '6', '', '3'),
            ('order', 'z', 0, 4, None, '', '', '4'),
        ],
    ),
    "case_multi_scopes": (
        ('var', 'n'),
        [
            ('order', 'x', 2),
        ],
    ),
    "case_skeletons": (
        ('chunk', 'signature', 'header', 'footer'),
        [
            ('order', 3, 'fn func3(x: &usize) -> (usize)', 'let mut y: usize = 0;', '(y)'),
            ('order', 4, 'fn func4()', 'let mut z: String = String::new();', ''),
        ],
    ),
    "case_unused": (
        ('node_id', 'var'),
        [
            ('order', 5, 'z'),
        ],
    ),
    "case_quiet": (
        ('pos', 'source'),
        [
            ('commands', 0, 'n=$(( {num} * 2 + count ))'),
            ('commands', 1, 'echo ${n} > out_{name}.txt'),
            ('commands', 2, 'cat in.txt | grep ${n} > log.txt'),
            ('commands', 3, 'rm -f log.txt tmp'),
            ('macros', 0, 'AC_INIT([{name}], [1.{num}.0])'),
            ('macros', 1, 'AM_CONDITIONAL([BIG_{num}], [test ${n} -gt 1])'),
            ('macros', 2, 'AC_CONFIG_LINKS([a.h:src/a{num}.h])'),
            ('macros', 3, 'AC_CHECK_HEADERS([stdio.h {name}.h])'),
        ],
    ),
    "case_written": (
        ('role', 'path'),
        [
            ('commands', 'removed', 'log.txt'),
            ('commands', 'removed', 'tmp'),
            ('commands', 'written', 'log.txt'),
            ('commands', 'written', 'out_{name}.txt'),
        ],
    ),
    "case_generated": (
        ('path',),
        [
            ('commands', 'out_{name}.txt'),
        ],
    ),
    "case_rust": (
        ('node_id', 'code'),
        [
            ('branches', 1, 'p_{name} = {num};'),
            ('branches', 2, 'if (with_{name} && !CC.is_empty()) {\n    LIBS.push("-l{name}".to_string());\n} else if level >= 3 {\n    LIBS = vec!["none".to_string()];\n} else {\n    // AC_MSG_ERROR([no {name}])\n}'),
            ('branches', 6, 'if !EXTRA.is_empty() {\n    EXTRA = false;\n}'),
            ('loops', 1, 'if (test("i?86") && test("linux*")) {\n    os = "linux".to_string();\n} else {\n    os = "other".to_string();\n}'),
            ('loops', 4, 'for f in ["a".to_string(), "{name}".to_string()] {\n    execute_cmd("eval", &[&format!("have_{}={}", f.clone(), os.clone())]);\n    execute_cmd("eval", &[&format!("v=$have_{}", f.clone())]);\n}'),
            ('loops', 7, 'match (if v { "yes" } else { "no" }).to_string().as_str() {\n    "yes" => {\n        w = true;\n    }\n    "no" | "off" => {\n        w = false;\n    }\n    _ => {\n        w = v.clone();\n    }\n}'),
            ('commands', 1, 'n = (({num} * 2) + (count as i64)).to_string();'),
            ('commands', 2, 'execute_cmd("echo", &[&"start".to_string()]);'),
            ('commands', 3, 'std::fs::write("out_{name}.txt".to_string(), n.display().to_string()).unwrap();'),
            ('commands', 5, 'execute_cmd("sh", &["-c", "cat in.txt | grep ${n} > log.txt"]);'),
            ('commands', 9, 'execute_cmd("rm", &[&"-f".to_string(), &"log.txt".to_string(), &"tmp".to_string()]);'),
            ('commands', 10, 'if !(test("test -f ${n}")) {\n    execute_cmd("exit", &[&"1".to_string()]);\n}'),
            ('commands', 12, 'while n < 9 {\n    n = (if ((n.parse::<i64>().unwrap_or_default() > 3) as i64) != 0 { n.parse::<i64>().unwrap_or_default() } else { (count as i64) }).to_string();\n    execute_cmd("break", &[]);\n}'),
            ('macros', 1, '// AC_INIT([{name}], [1.{num}.0])'),
            ('macros', 2, '// AC_PREREQ([2.69])'),
            ('macros', 3, '// AM_CONDITIONAL([BIG_{num}], [test ${n} -gt 1])'),
            ('macros', 4, 'ln -s src/a{num}.h a.h'),
            ('macros', 5, 'if check_header("stdio.h") {\n    println!("cargo:rustc-cfg=have_stdio_h");\n}\nif check_header("{name}.h") {\n    println!("cargo:rustc-cfg=have_{name}_h");\n}'),
            ('macros', 6, 'if let Some(lib) = check_library("deflate", &["z"], &[], false) {\n    LIBS.push(lib);\n    println!("cargo:rustc-cfg=have_libz");\n}'),
            ('macros', 7, 'println!("cargo:rustc-cfg=have_{name}");'),
            ('macros', 8, 'println!("cargo:rustc-env=V=a{}", b);'),
            ('macros', 9, '// AC_ARG_VAR([CC], [compiler])'),
            ('macros', 10, 'if let Some(size) = check_sizeof("long", "") {\n    println!("cargo:rustc-env=SIZEOF_LONG={}", size);\n}'),
            ('macros', 11, '// AC_MSG_NOTICE([done])'),
        ],
    ),
    "case_relevant_macros": (
        ('name',),
        [
            ('macros', 'AC_CHECK_HEADERS'),
            ('macros', 'AC_CHECK_LIB'),
            ('macros', 'AC_CHECK_SIZEOF'),
            ('macros', 'AC_CONFIG_LINKS'),
            ('macros', 'AC_DEFINE'),
            ('macros', 'AC_DEFINE_UNQUOTED'),
            ('macros', 'AC_INIT'),
            ('macros', 'AM_CONDITIONAL'),
        ],
    ),
    "case_conditionals": (
        ('condition', 'test'),
        [
            ('macros', 'BIG_{num}', 'test ${n} -gt 1'),
        ],
    ),
    "case_links": (
        ('target', 'source'),
        [
            ('macros', 'a.h', 'src/a{num}.h'),
        ],
    ),
    "case_banned": (
        ('name',),
        [
            ('macros', 'AC_ARG_VAR'),
            ('macros', 'AC_INIT'),
            ('macros', 'AC_MSG_NOTICE'),
            ('macros', 'AC_PREREQ'),
            ('macros', 'AM_CONDITIONAL'),
        ],
    ),
    "case_option_variables": (
        ('option', 'var'),
        [
            ('options', 'dep', 'with_dep'),
            ('options', '{name}', 'enable_{name}'),
            ('options', '{name}', 'use'),
        ],
    ),
    "case_option_guards": (
        ('node_id', 'guard', 'name', 'cond_kind'),
        [
            ('options', 7, 0, '{name}', 'True'),
            ('options', 10, 0, '{name}', 'True'),
            ('options', 10, 1, '{name}', 'Eq'),
        ],
    ),
    "case_option_contexts": (
        ('option', 'var'),
        [
            ('options', 'dep', 'with_dep'),
            ('options', '{name}', 'enable_{name}'),
            ('options', '{name}', 'use'),
            ('options', '{name}', '{name}_extra'),
        ],
    ),
    "case_option_candidates": (
        ('option', 'value'),
        [
            ('options', 'dep', 'no'),
            ('options', 'dep', 'yes'),
            ('options', '{name}', 'fast'),
            ('options', '{name}', 'no'),
            ('options', '{name}', 'yes'),
        ],
    ),
    "case_option_disabling": (
        ('option', 'node_id'),
        [
            ('options', 'dep', 14),
        ],
    ),
    "case_option_enabling": (
        ('option', 'node_id', 'needed_by'),
        [
            ('options', 'dep', 9, '{name}'),
        ],
    ),
    "case_option_values_passed": (
        ('node_id', 'var'),
        [
            ('options', 13, 'mode'),
        ],
    ),
    "case_undeclared": (
        ('node_id', 'kind'),
        [
            ('options', 7, 'If'),
            ('options', 8, 'Assignment'),
            ('options', 9, 'Assignment'),
            ('options', 10, 'Case'),
            ('options', 11, 'Assignment'),
            ('options', 12, 'Assignment'),
            ('options', 13, 'Assignment'),
            ('options', 14, 'Assignment'),
        ],
    ),
    "case_used_options": (
        ('option',),
        [
            ('options', '{name}'),
        ],
    ),
    "case_guarded_blocks": (
        ('name', 'node_id', 'guard'),
        [
            ('options', 'use', 7, 0),
            ('options', 'use', 10, 0),
            ('options', 'use', 10, 1),
            ('branches', 'CC', 2, 0),
            ('branches', 'EXTRA', 6, 0),
            ('branches', 'level', 2, 1),
            ('branches', 'with_{name}', 2, 0),
        ],
    ),
    "case_outermost_guarded": (
        ('name', 'node_id'),
        [
            ('options', 'use', 7),
            ('options', 'use', 10),
            ('branches', 'CC', 2),
            ('branches', 'EXTRA', 6),
            ('branches', 'level', 2),
            ('branches', 'with_{name}', 2),
        ],
    ),
    "case_touching": (
        ('var', 'node_id'),
        [
            ('order', 'CC', 1),
            ('order', 'i', 8),
            ('order', 'i', 9),
            ('order', 'p', 9),
            ('order', 'p', 10),
            ('order', 'x', 2),
            ('order', 'x', 4),
            ('order', 'x', 6),
            ('order', 'x', 10),
            ('order', 'y', 4),
            ('order', 'y', 7),
            ('order', 'z', 5),
        ],
    ),
    "case_dictionaries": (
        ('dict', 'op', 'keys'),
        [
            ('loops', 'have_@', 'Read', 'f'),
            ('loops', 'have_@', 'Write', 'f'),
        ],
    ),
    "case_values": (
        ('var', 'value'),
        [
            ('loops', 'f', 'a'),
            ('loops', 'f', '{name}'),
            ('loops', 'os', 'linux'),
            ('loops', 'os', 'other'),
            ('loops', 'v', '$have_a'),
            ('loops', 'v', '$have_{name}'),
            ('loops', 'w', '$have_a'),
            ('loops', 'w', '$have_{name}'),
            ('loops', 'w', '0'),
            ('loops', 'w', '1'),
            ('branches', 'EXTRA', 'no'),
            ('branches', 'LIBS', 'none'),
            ('branches', 'p_{name}', '{num}'),
        ],
    ),
    "case_pruned": (
        ('pos', 'source'),
        [
            ('commands', 0, 'n=$(( {num} * 2 + count ))'),
            ('commands', 1, 'cat in.txt | grep ${n} > log.txt'),
            ('commands', 2, 'test -f ${n} || exit 1'),
            ('commands', 3, 'while test ${n} -lt 9; do\n  n=$((n > 3 ? n : count))\n  break\ndone'),
        ],
    ),
    "case_flattened": (
        ('pos', 'kind', 'text'),
        [
            ('branches', 0, 'Assignment', 'p_{name}'),
            ('branches', 1, 'Function', 'part_2_1'),
            ('branches', 2, 'Function', 'part_2_2'),
            ('branches', 3, 'Function', 'part_2_3'),
            ('branches', 4, 'If', ''),
            ('branches', 5, 'Function', 'part_9_4'),
            ('branches', 6, 'If', ''),
            ('commands', 0, 'Assignment', 'n'),
            ('commands', 1, 'Command', ''),
            ('commands', 2, 'Redirect', ''),
            ('commands', 3, 'Pipe', ''),
            ('commands', 4, 'Command', ''),
            ('commands', 5, 'Or', ''),
            ('commands', 6, 'Function', 'part_7_1'),
            ('commands', 7, 'While', ''),
        ],
    ),
    "case_guard_tests": (
        ('node_id', 'branch', 'test', 'replaceable', 'literals', 'negated'),
        [
            ('branches', 2, 0, 'test "${with_{name}}" = yes && ! test -z "${CC}"', False, '', '! test "${with_{name}}" = yes || test -z "${CC}"'),
            ('branches', 2, 1, 'test "${level}" -ge 3', True, '', '! test "${level}" -ge 3'),
            ('branches', 6, 0, 'test -n "${EXTRA+set}"', True, '', '! test -n "${EXTRA+set}"'),
            ('options', 7, 0, 'test "${use}" = yes', True, 'yes', '! test "${use}" = yes'),
        ],
    ),
    "case_translated": (
        ('part', 'pos', 'text'),
        [
            ('order', 'function', 0, 'fn func7(x: &usize) {\n}\n'),
            ('order', 'main', 0, 'execute_cmd("echo", &[&CC.clone()]);'),
            ('order', 'main', 1, 'x = {num};'),
            ('order', 'main', 2, 'execute_cmd("echo", &[&"done".to_string()]);'),
            ('order', 'main', 3, 'y = x.clone();'),
            ('order', 'main', 4, 'z = "unused{num}".to_string();'),
            ('order', 'main', 5, 'x = 2;'),
            ('order', 'main', 6, 'execute_cmd("echo", &[&y.to_string()]);'),
            ('order', 'main', 7, 'func7(&x);'),
            ('order', 'main', 8, '// AC_SUBST([y])'),
        ],
    ),
    "case_helpers": (
        ('kind', 'text'),
        [
            ('order', 'bindgen', 'run_bindgen(std::iter::empty::<String>().chain(A_CFLAGS.iter().flat_map(|x| x.split_whitespace()).map(str::to_string)));'),
            ('order', 'call', '(c, d) = func4(&a, &mut b);'),
            ('order', 'call', 'c = func3(a, b);'),
            ('order', 'default', '0'),
            ('order', 'default', 'None'),
            ('order', 'default', 'PathBuf::new()'),
            ('order', 'default', 'String::new()'),
            ('order', 'default', 'Vec::new()'),
            ('order', 'default', 'false'),
            ('order', 'directory', '/opt'),
            ('order', 'directory', '/usr/include'),
            ('order', 'directory', 'C:\\a'),
            ('order', 'directory', 'D:\\b'),
            ('order', 'dummy', 'fn func5(a: &mut usize) -> (bool, Vec<PathBuf>) {\n    (false, Vec::new())\n}\n'),
            ('order', 'escaped', '"a\\"b\\\\c\\td\\u{1}"'),
            ('order', 'export', 'if !a.is_empty() {\n    println!("cargo:rustc-cfg=a");\n}'),
            ('order', 'export', 'println!("cargo:rustc-env=b={}", b);'),
            ('order', 'export', 'println!("cargo:rustc-env=c={num}");'),
            ('order', 'merged', "{'snippets': ['a', 'b'], 'regex': True}"),
            ('order', 'name', 'func3'),
            ('order', 'needs', 'check_header run_pkg_config'),
            ('order', 'optional', 'v.is_some() v.is_none()'),
            ('order', 'placeholder', '__CODE_{num}__ {} {}'),
            ('order', 'start', 'let mut v: usize = option_env!("v").unwrap_or_default().parse().unwrap_or_default();'),
            ('order', 'text', '(if v { "yes" } else { "no" }).to_string()'),
            ('order', 'text', 'v.clone()'),
            ('order', 'text', 'v.display().to_string()'),
            ('order', 'text', 'v.join(" ")'),
            ('order', 'text', 'v.to_string()'),
            ('order', 'type', 'Option<usize>'),
            ('order', 'type', 'Vec<Vec<PathBuf>>'),
        ],
    ),
    "case_guard_rewrites": (
        ('node_id', 'branch', 'supported', 'without_empty', 'contradictory', 'dead'),
        [
            ('loops', 1, 0, '(Arch i686 & Os linux)', '(ArchGlob Match i?86 & OsAbiGlob Match linux*)', False, False),
            ('loops', 1, 1, 'true', 'true', True, False),
            ('loops', 7, 0, 'Var v True', 'Var v True', True, False),
            ('loops', 7, 1, '(Var v Eq off | Var v False)', '(Var v Eq off | Var v False)', False, False),
            ('loops', 7, 2, 'true', 'true', True, False),
            ('branches', 2, 0, '(!Var CC Empty & Var with_{name} True)', 'Var with_{name} True', False, False),
            ('branches', 2, 1, 'Var level Ge 3', 'Var level Ge 3', True, False),
            ('branches', 6, 0, 'Var EXTRA Set', 'Var EXTRA Set', True, False),
        ],
    ),
    "case_paths": (
        ('node_id', 'word', 'paths', 'parts', 'absolute'),
        [
            ('paths', 3, 1, '-r', 'Lit -r', False),
            ('paths', 3, 2, 'src/{name},src/{name}/a', 'Var d|Lit /|Var s', False),
            ('paths', 3, 3, '/opt/src/{name}', 'Lit opt/|Var d', True),
            ('paths', 5, 1, '', 'Lit -', False),
            ('paths', 5, 2, 'out/{name}.o', 'Lit out/{name}.o', False),
        ],
    ),
    "case_delimited": (
        ('node_id', 'guards', 'error_out'),
        [
            ('paths', 5, '(Var d Eq src & Var s Eq {num})', False),
        ],
    ),
    "case_visited": (
        ('pos', 'n'),
        [
            ('loops', 0, 201),
            ('loops', 1, 3),
            ('loops', 2, 301),
            ('commands', 0, 100),
            ('commands', 1, 1),
            ('commands', 2, 2),
            ('commands', 3, 4),
            ('commands', 4, 1),
            ('commands', 5, 2),
            ('commands', 6, 102),
            ('paths', 0, 100),
            ('paths', 1, 2),
            ('paths', 2, 2),
        ],
    ),
    "case_scope_types": (
        ('var', 'idx', 'type'),
        [
            ('order', 'CC', 0, 'Literal'),
            ('order', 'i', 0, 'Literal'),
            ('order', 'p', 0, 'Literal'),
            ('order', 'x', 0, 'Integer'),
            ('order', 'x', 1, 'Path'),
            ('order', 'y', 0, 'Integer'),
            ('order', 'z', 0, 'Literal'),
        ],
    ),
    "case_cleaned": (
        ('tbl', 'n'),
        [
            ('order', 'edge', 2),
            ('order', 'event', 9),
            ('order', 'node', 9),
        ],
    ),
    "case_chunk_dump": (
        ('chunk', 'text'),
        [
            ('order', 3, '#4 y=${x}\nfn func3(x: &usize) -> (usize)\nlet mut y: usize = 0;\n(y)'),
            ('order', 7, '#8 for i in 1 2; do\n  p=${i}\ndone\n#10 echo ${x} ${p}\nfn func7(x: &usize)\nlet mut i: String = String::new();\nlet mut p: String = String::new();'),
        ],
    ),
    "case_in_brace": (
        ('pos', 'source'),
        [
            ('commands', 0, 'n=$(( {num} * 2 + count ))'),
            ('commands', 1, '{\n  echo start\n  echo ${n} > out_{name}.txt\n}'),
            ('commands', 2, 'cat in.txt | grep ${n} > log.txt'),
        ],
    ),
    "case_approximated": (
        ('pos', 'guards', 'about'),
        [
            ('branches', 0, 'false', False),
            ('branches', 1, 'Arg EXTRA True', False),
            ('branches', 2, 'false', True),
            ('branches', 3, 'Arg EXTRA True', False),
        ],
    ),
}
